"""Every operator against a plain version of itself, on small tables with nulls, empties, ties and repeats."""

import base64
import collections
import gzip
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import decontam, jaccard, packing, quality, secrets, suffix_dedup, token_counts, token_files, topk, url_filter
from maskwright.llm.queries import tokenizer_path

KIND = "doc_id long, text string, start string, kind string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], KIND)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdeéß"), rng.integers(2, 7))) for _ in range(150)]
    out = [" ".join(rng.choice(vocab, rng.integers(0, 120))) for _ in range(60)]
    for k in range(20):
        w = out[k].split(" ")
        if w:
            w[int(rng.integers(0, len(w)))] = "changed"
        out.append(" ".join(w))
    out += [out[3], out[3], "", None, "one", "Two words", " \t\n", "x" * 300, "x" * 300]
    return list(enumerate(out))


def test_secrets(spark):
    x = 'token = "abcdefgh12345678"'
    packed = base64.b64encode(gzip.compress(base64.b64encode(x.encode()))).decode()
    df = docs_of(spark, [(1, "é " + x), (2, packed), (3, None), (4, ""), (5, "%74oken%3Dabcdefgh1"), (5, "password=short"), (6, "".join(f"\\u{ord(c):04x}" for c in x))])
    got = collections.defaultdict(list)
    for r in secrets.digest(secrets.scan_secrets(df)).collect():
        got[r.doc_id].append((r.n_assign, r.spans))
    assert got[1] == [(1, "assign:2:27")] and got[2] == [(0, f"assign:0:{len(packed)}")] and got[3] == got[4] == [(0, "")]
    assert sorted(got[5]) == [(0, ""), (0, "assign:0:19")] and got[6] == [(0, f"assign:0:{6 * (len(x) - 1)}")]
    assert secrets.scan_secrets(df.limit(0)).count() == 0
    assert secrets.cover("abcdef", [(1, 3), (2, 4)], "#") == "a#ef"


def test_suffix_dedup(spark, rows):
    n, first, want = 20, {}, {}
    for i, t in rows:
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if first.setdefault(b[p : p + n], i) < i:
                hit[p : p + n] = True
        want[i] = (len(b), int(hit.sum()), hashlib.sha256(bytes(c for c, g in zip(b, hit, strict=True) if not g)).hexdigest())
    for batch in (1500, 1 << 20):
        got = suffix_dedup.SuffixDedup(docs_of(spark, rows), n, q=8, batch_bytes=batch, bucket_bytes=batch).result().collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in got} == want
    assert suffix_dedup.remove_repeats(docs_of(spark, [])).count() == 0


def test_url_filter(spark):
    a = '<a href="http://bad.net/x">'
    df = spark.createDataFrame([(1, "http://x.bad.net/", None), (2, "https://B.Example.net/en/1?x", ""), (3, "nothing", a), (4, None, a), (5, "http://links.org/de/", '<a href="//x.bad.net/1">'), (6, "http://q.com", None)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got[1] == ("x.bad.net", "/", "net/", "block") and got[2] == ("b.example.net", "/en/1", "example.net/en/", "allow")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5] == ("links.org", "/de/", None, "block") and got[6] == ("q.com", "", None, "allow")


def test_token_counts():
    best, cross = token_counts.attribute(np.array([0, 3, 6, 9]), np.array([3, 6, 9, 12]), np.array([0, 5]), np.array([4, 9]))
    assert best.tolist() == [0, 0, 1, -1] and cross.tolist() == [False, True, False, False]


def test_token_counts_cover_all_tokens(spark, rows):
    enc, _ = token_counts.encoding(tokenizer_path("byte_bpe_50k.tiktoken"))
    df = docs_of(spark, rows)
    got = token_counts.count_tokens(df, token_counts.title_body_tail(), tokenizer_path("byte_bpe_50k.tiktoken")).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: len(enc.encode_ordinary(t or "")) for i, t in rows}


def test_token_files(spark, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    odd = [(900, "it's Don't <|endoftext|> É×÷ 日本語\tb\r\n12ab!? 'll"), (901, "😀a  x"), (901, "😀a  x")]
    t, at, want = Tokenizer.from_file(path), 0, []
    for i, x in [*rows, *odd]:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_files.round_trip(docs_of(spark, [*rows, *odd]), path).collect()) == sorted(want)
    raw = bytearray(token_files.frame(b"payload"))
    raw[13] ^= 1
    import io

    with pytest.raises(ValueError):
        list(token_files.read_frames(io.BytesIO(bytes(raw))))


def test_jaccard(spark, rows):
    for n, num in ((3, 90), (5, 80)):
        sets, parent = {}, {}
        for i, t in rows:
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            sets[i], parent[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set(), i

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in sets:
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        got = jaccard.jaccard_components(docs_of(spark, rows), n=n, num=num).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), find(i)) for i in sets}


def test_topk(spark):
    rng = np.random.default_rng(3)
    v = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 330)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (450, [1.0, 2.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    ints = {i: np.floor(256 * np.array(x, np.float32).astype(float)) for i, x in v if x and None not in x and np.isfinite(x).all()}
    want = []
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q and len(x) == len(ints[q]))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = topk.exact_topk(df, df.where("vec_id % 50 = 0"), block=3, chunk=50).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_packing(spark, rows):
    best = packing.optimal_bounds(np.array([1.0, 2, 9, 10]), np.array([5, 1, 1, 9]), 2)
    assert best == [2, 10]
    got = packing.pack(docs_of(spark, rows), buckets=4, budget=200).collect()
    assert len(got) == len(rows) and len({(r.batch_id, r.slot) for r in got}) == len(rows)
    load = collections.Counter(r.batch_id for r in got)
    assert all(load[r.batch_id] * r.bucket_len <= 200 or load[r.batch_id] == 1 for r in got) and all(r.n_tokens <= r.bucket_len for r in got)
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_decontaminate(spark, rows):
    items = [(1, rows[0][1]), (2, rows[5][1]), (3, "changed"), (4, None), (4, ""), (2, rows[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t or "")
    win = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 7)):
            if w:
                win[tuple(w[k : k + 8])].add(i)
    want = {}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for p, owners in win.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= owners
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(found) >= 2)
    for size in (8 << 20, 300):
        got = decontam.digest(decontam.decontaminate(docs_of(spark, rows), bench, block_bytes=size)).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_quality(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["the", "house", "stands", "near", "river"], 30)) for _ in range(200)]
    rows = [(i, t if i % 3 else t.upper().replace(" ", "!! ")) for i, t in enumerate(good)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs_of(spark, rows), labels).collect()}
    assert len(got) == 202 and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].predicted == int(i % 3 > 0) for i in range(200) if got[i].held_out) >= 0.95 * sum(got[i].held_out for i in range(200))
    assert quality.classify(docs_of(spark, rows), labels.limit(0)).first().score == 0.5


def components_by_hand(rows, n, num):
    """(sets by row, find): documents are ids, any text of one may link it."""
    sets, root = [], {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                root[y] = x
    return sets, find


def test_jaccard_repeated_ids_and_hot_tokens(spark, monkeypatch):
    w = "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd ee ff".split()
    one, two = " ".join(w), " ".join(x * 2 for x in w)
    rows = [(1, one), (1, two), (2, one + " end"), (3, two + " end"), (9, two + " fin"), (9, "other text of nine that has words enough for a set of its own"), (10, "other text of nine that has words enough for a set of its own")]
    # one phrase that many texts share, and near copies whose lists are dealt to parts
    rng = np.random.default_rng(3)
    base = [str(x) for x in rng.integers(0, 10**6, 60)]
    for k in range(60):
        t = list(base)
        t[int(rng.integers(0, 60))] = f"x{k}"
        rows.append((100 + k, " ".join(t)))
    rows += [(300 + k, "the shared phrase stands here " + " ".join(str(x) for x in rng.integers(0, 10**6, 30))) for k in range(40)]
    sets, find = components_by_hand(rows, 3, 90)
    monkeypatch.setattr(jaccard, "LIST", 7)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, rows), n=3, num=90).collect())
    assert got == sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True))
    assert find(3) == 1 and find(10) == 1


def test_keep_one_of_repeated_and_null_ids(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(5, t), (5, t), (7, t), (None, t), (None, "alone here with words enough to be a set"), (None, "alone here with words enough to be a set"), (8, ""), (8, ""), (None, None), (11, "b " + t + " c d e f g h"), (11, "a text of its own that shares nothing with any")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in jaccard.keep_one(docs_of(spark, rows)).collect())
    want = [(5, t), (8, ""), (8, ""), (11, "a text of its own that shares nothing with any"), (None, None), (None, "alone here with words enough to be a set")]
    assert got == sorted((i is None, i or 0, x or "") for i, x in want)
    assert jaccard.keep_one(docs_of(spark, [])).count() == 0


def test_bounds_are_optimal():
    rng = np.random.default_rng(9)
    for _ in range(40):
        lengths = np.unique(rng.integers(0, 200, rng.integers(1, 30)))
        counts, k = rng.integers(1, 50, len(lengths)), int(rng.integers(1, 8))
        cost = {(0, 0): 0}
        for j in range(1, len(lengths) + 1):
            for b in range(1, min(j, k) + 1):
                cost[b, j] = min(cost[b - 1, i] + int(counts[i:j].sum()) * int(lengths[j - 1]) for i in range(j) if (b - 1, i) in cost)
        least = min(v for (b, j), v in cost.items() if j == len(lengths))
        bounds = packing.optimal_bounds(lengths, counts, k)
        assert len(bounds) <= k and bounds[-1] == lengths[-1] and set(bounds) <= set(lengths.tolist())
        assert sum(int(c) * next(b for b in bounds if b >= x) for x, c in zip(lengths, counts, strict=True)) == least


def test_packing_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c")] * 30 + [(7, "d e")] * 30 + [(8, None), (9, "")]
    got = packing.pack(docs_of(spark, rows), buckets=2, budget=12).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((i or 0, len((t or "").split())) for i, t in rows)
    assert len({(r.batch_id, r.slot) for r in got}) == len(rows) and packing.optimal_bounds(np.array([2, 3]), np.array([30, 30]), 1) == [3]
