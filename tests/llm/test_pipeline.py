"""The pipeline against a plain version of its stages, each stage on what its predecessor kept."""

import itertools
import re

import numpy as np
import pytest

import corpus_pipeline
from maskwright.llm import quality, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD, SHINGLE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    vocab = np.array(["".join(rng.choice(list("abcdefghiklmnoprstu"), 5)) for _ in range(300)])
    clean = [" ".join(rng.choice(vocab, 60)) + "." for _ in range(120)]
    bad = ["".join(rng.choice(list("#$%!?1234XYZ "), 300)) for _ in range(60)]
    items = [" ".join(rng.choice(vocab, 14)) for _ in range(4)] + ["brief exam item", None, ""]
    own = [" ".join(rng.choice(vocab, 60)) for _ in range(4)]
    rows = [(k, t) for k, t in enumerate(clean + bad)]
    rows += [(200, clean[3]), (201, clean[3]), (202, clean[4].replace(".", " more.")), (203, own[3] + " " + items[0] + " tail é"), (204, items[1].upper() + " and " + items[2] + " " + clean[6][:150])]
    rows += [(205, own[0] + " password = hunter2hunter2 end"), (206, own[1] + " the brief exam item is here"), (207, None), (208, ""), (208, ""), (209, own[2] + " token%3Dabcdefgh12345 x")]
    docs = [(i, t, None if i % 7 == 0 else "en", "hot" if i % 3 else None, len(t) if t is not None else None) for i, t in rows]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 120)) for k in range(180) if k % 4], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n=5):
    w = re.findall(SHINGLE_WORD, lower(text))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def kept_of_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(i, t) for i, t in rows if find(i) == i]


def without_leaks(rows, items):
    windows = []
    for k, t in enumerate(items):
        w = re.findall(WORD, lower(t))
        windows += [(k, w[p : p + 8]) for p in range(max(1, len(w) - 7)) if w]
    out = []
    for i, t in rows:
        words = list(re.finditer(WORD, lower(t)))
        low = [m[0] for m in words]
        hits = [(k, p, p + len(w)) for k, w in windows for p in range(len(low) - len(w) + 1) if low[p : p + len(w)] == w]
        if len({k for k, _, _ in hits}) >= 2:
            continue
        hit = sorted({p for _, a, b in hits for p in range(a, b)})
        cut = set()
        for p in hit:  # a run of hit words goes with what lies between them
            cut.update(range(words[p].start(), words[p + 1].start() if p + 1 in hit else words[p].end()))
        out.append((i, t if t is None else "".join(c for j, c in enumerate(t) if j not in cut)))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_and_run(spark, corpus):
    path, items = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "near_copies", "decontaminate", "secrets", "packing"]

    first = stage["quality"](spark, docs, path)
    predicted = {r.doc_id: r.predicted for r in quality.classify(docs, spark.read.parquet(f"{path}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in first.collect()) == sorted(r.doc_id for r in docs.collect() if predicted[r.doc_id] == 1)
    assert sum(predicted[k] for k in range(120)) >= 118 and sum(predicted[k] for k in range(120, 180)) <= 2

    # the later stages on all documents, so that what the first one decides of odd texts does not matter
    second = stage["near_copies"](spark, docs, path)
    want = kept_of_groups(rows_of(docs))
    assert rows_of(second) == sorted(want, key=str) and {200, 201, 202}.isdisjoint(i for i, _ in want)
    third = stage["decontaminate"](spark, second, path)
    want = without_leaks(want, items)
    assert rows_of(third) == sorted(want, key=str) and 204 not in dict(want) and items[0] not in dict(want)[203]
    fourth = stage["secrets"](spark, third, path)
    found = {r.doc_id: [(s.start, s.end) for s in [*r.base, *r.added]] for r in secrets.scan_secrets(third).collect()}
    masked = sorted(((i, secrets.cover(t, found[i], "[SECRET]") if t and found[i] else (t or t)) for i, t in want), key=str)
    got = rows_of(fourth)
    assert [(i, t or "") for i, t in got] == [(i, t or "") for i, t in masked]
    assert "hunter2" not in dict(got)[205] and "abcdefgh12345" not in dict(got)[209] and "[SECRET]" in dict(got)[209]
    for made in (first, second, third, fourth):
        assert made.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in fourth.collect() if r.text)
    fifth = stage["packing"](spark, fourth, path).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in fifth) == sorted((i, len(re.findall(SHINGLE_WORD, t or ""))) for i, t in got)

    step = docs
    for _, f in corpus_pipeline.STAGES:
        step = f(spark, step, path)
    assert sorted(map(str, corpus_pipeline.run(spark, path).collect())) == sorted(map(str, step.collect()))
