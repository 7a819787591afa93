"""The suffix-array dedup against plain loops: hot prefixes, repeated ids, levels, runs of one letter, long texts."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import suffix_dedup

LEAST = -(1 << 63)


def dedup_by_hand(rows, n):
    """doc_id and text to (bytes, removed, hash of what is kept), as a sorted list."""
    first = {}
    for i, t in rows:
        b, i = (t or "").encode(), LEAST if i is None else i
        for p in range(len(b) - n + 1):
            first[b[p : p + n]] = min(first.get(b[p : p + n], i), i)
    out = []
    for i, t in rows:
        b, hit = (t or "").encode(), np.zeros(len((t or "").encode()), bool)
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < (LEAST if i is None else i):
                hit[p : p + n] = True
        out.append((i, len(b), int(hit.sum()), hashlib.sha256(bytes(c for c, g in zip(b, hit, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def by_bucket(sent, f, kind):
    got = [f(sent.filter(pc.equal(sent.column("bucket"), b))) for b in sent.column("bucket").unique().to_pylist()]
    names = {x.split(" ")[0]: pa.array([], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split(" ")[1]]) for x in kind.split(", ")}
    return pa.concat_tables(got) if got else pa.table(names)


def digests(table, n, q, batches=1, buckets=1):
    """The operator's own steps over a table, without Spark."""
    lay = suffix_dedup.Layout(n, q)
    of = np.arange(table.num_rows) % batches
    parts = {k: suffix_dedup.Batch(table.filter(pa.array(of == k)), lay, buckets) for k in range(batches)}
    sent = pa.concat_tables([suffix_dedup._entry_table(k, b) for k, b in parts.items()])
    flags = by_bucket(sent, lambda x: suffix_dedup._match(x, lay), suffix_dedup.FLAGS)
    mine = lambda found, k: found.filter(pc.equal(found.column("batch"), k))
    sent = pa.concat_tables([suffix_dedup._context_table(k, b, mine(flags, k)) for k, b in parts.items()])
    masks = by_bucket(sent, lambda x: suffix_dedup._match_contexts(x, lay), suffix_dedup.MASKS)
    out = []
    for k, b in parts.items():
        out += [(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup._cut_batch(b, mine(flags, k), mine(masks, k)).to_pylist()]
    return sorted(out, key=str)


def table_of(rows):
    return pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})


@pytest.mark.parametrize("batches, buckets", [(1, 1), (7, 3), (32, 5)])
def test_hot_prefix_repeated_and_null_ids(batches, buckets):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(2, 8))) for _ in range(60)]
    rows = []
    for k in range(150):
        t = " ".join(rng.choice(words, 12)) + (" the boilerplate line of all documents " if k % 3 else "") + " ".join(rng.choice(words, 12))
        rows.append((None if k % 17 == 0 else int(rng.integers(0, 60)), t))
    rows += [(70, rows[1][1]), (70, rows[1][1]), (3, rows[2][1]), (None, rows[5][1]), (71, None), (72, ""), (73, "x" * 500), (74, "x" * 300 + "y" + "x" * 300)]
    rng.shuffle(rows)
    assert digests(table_of(rows), 30, 10, batches, buckets) == dedup_by_hand(rows, 30)


def test_many_continuations_of_one_prefix():
    head, rng = "a string that starts many", np.random.default_rng(4)
    rows = [(k, head + "".join(rng.choice(list("0123456789"), 26))) for k in range(20_000)]
    rows += [(30_000, rows[77][1] + "z"), (30_001, "q" + rows[78][1])]
    got = dict((r[0], r[2]) for r in digests(table_of(rows), 50, 20, 4, 2))
    assert got[30_000] == got[30_001] == len(head) + 26
    # a chance match needs all 50 bytes
    assert sum(v for k, v in got.items() if k < 30_000) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.one_of(st.none(), st.text(alphabet="ab\0é", max_size=40))), max_size=12), st.integers(1, 4), st.integers(1, 3))
def test_any_small_corpus(rows, batches, buckets):
    assert digests(table_of(rows), 8, 3, batches, buckets) == dedup_by_hand(rows, 8)


def test_levels_are_logarithmically_many():
    lay = suffix_dedup.Layout(8, 3)
    family, rng, seen = suffix_dedup.Family(lay.entry), np.random.default_rng(1), set()
    for k in range(40):
        raw = sorted({bytes(x) for x in rng.integers(97, 101, (30, 3), np.uint8)})
        rows = np.zeros((len(raw), lay.entry.itemsize), np.uint8)
        rows[:, :3] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 3)
        later, _, _ = family.add(rows.reshape(-1).view(lay.entry), np.full(len(raw), k), k)
        assert [bool(x) for x in later] == [x in seen for x in raw]
        seen |= set(raw)
        assert all(len(a[0]) >= 2 * len(b[0]) for a, b in zip(family.levels, family.levels[1:]))
    assert len(family.all()[0]) == len(seen)


def test_long_text():
    rng = np.random.default_rng(6)
    long_ = "".join(rng.choice(list("abcdefghij "), 3_000_000))
    rows = [(1, long_), (2, long_[1_000_000:1_000_400] + "!"), (3, "z" * 2_500_000)]
    got = {r[0]: r[2] for r in digests(table_of(rows), 50, 20, 3, 2)}
    assert got == {1: 0, 2: 400, 3: 0}


def test_prefixes_are_compared_by_their_bytes(monkeypatch):
    """Entries with different prefixes stay apart even if all hashes of their contexts are equal."""
    rng = np.random.default_rng(8)
    rows = [(k, "".join(rng.choice(list("abcdefgh"), 90))) for k in range(40)]
    rows += [(50, rows[3][1]), (51, rows[4][1][:70])]
    whole = suffix_dedup.Anchors.__init__

    def flat(self, *a):
        whole(self, *a)
        self.reach = np.zeros(len(self.reach), np.uint64)

    want = dedup_by_hand(rows, 50)
    assert digests(table_of(rows), 50, 20) == want
    monkeypatch.setattr(suffix_dedup.Anchors, "__init__", flat)
    got = {r[0]: r[2] for r in digests(table_of(rows), 50, 20)}
    assert sum(v for k, v in got.items() if k < 50) == 0 and got[50] == 90
