"""Near-duplicates, lines, embeddings and decontamination against brute force."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate, embed_dedup, line_dedup, near_dup
from tessera.llm.common import Workspace, components

from .conftest import text


def brute_components(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.node: r.root for r in components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    want = brute_components({n for e in edges for n in e}, edges)
    assert all(got.get(n, n) == r for n, r in want.items())
    assert components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long"), "c").count() == 0


def shingle_sets(rows, width):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        out[d] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    return out


def brute_near(rows, width, num, den):
    s = shingle_sets(rows, width)
    ids = sorted(s)
    return s, brute_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b])])


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates(spark, block, monkeypatch):
    """Chains and stars of copies; small blocks force the rounds for large groups."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(2)
    rows = [(k, text(rng, rng.randint(1, 80))) for k in range(30)]
    for g in range(4):
        words = text(rng, 70).split()
        for k in range(12):
            rows.append((100 * (g + 1) + k, " ".join(words)))
            if k % 3:
                words[rng.randrange(70)] = "w%d" % k
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE two")]
    s, want = brute_near(rows, 3, 85, 100)
    got = near_dup.cluster(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t"), 3, 85, 100).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(s[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id])


def test_near_duplicates_odd(spark, odd_docs, no_docs):
    got = near_dup.cluster(odd_docs, Workspace(spark, "t"), 3, 85, 100).collect()
    assert len(got) == odd_docs.count()
    comp = collections.defaultdict(set)
    for r in got:
        comp[r.doc_id].add(r.component_id)
    assert comp[1] == {0} and comp[2] == {0} and comp[3] == {3} and comp[4] == {4} and comp[None] <= {None, 0}
    assert near_dup.cluster(no_docs, Workspace(spark, "t"), 3, 85, 100).count() == 0


def edit_at_most_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def test_lines(spark):
    rng = random.Random(7)
    pool = [text(rng, rng.randint(3, 12)) for _ in range(40)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(pool).split()
            k = rng.randrange(len(w))
            w = {0: w, 1: w[:k] + w[k + 1 :], 2: w[:k] + ["new"] + w[k:], 3: w[:k] + ["other"] + w[k + 1 :], 4: w}[rng.randrange(5)]
            lines.append(" ".join(w) if rng.random() < 0.8 else "  ".join(w).upper() + "\t")
        rows.append((d, "\n".join(lines)))
    rows += [(50, None), (51, ""), (52, "\n\n")]
    all_lines = [(d, k, x.lower().split()) for d, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    kept = [x for x in all_lines if len(x[2]) >= line_dedup.MIN_WORDS]
    gone = {x[:2] for i, x in enumerate(kept) if any(edit_at_most_one(x[2], y[2]) for y in kept[:i])}
    for least in (5, 1):
        short = [x for x in all_lines if least <= len(x[2]) < line_dedup.MIN_WORDS]
        cut = gone | {x[:2] for i, x in enumerate(short) if any(x[2] == y[2] for y in short[:i])}
        got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t"), least).collect()}
        for d, t in rows:
            want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in cut)
            assert got[d].text == want
            assert got[d].n_removed == sum(g[0] == d for g in cut)


def test_lines_odd(spark, odd_docs, no_docs):
    got = line_dedup.dedup_lines(odd_docs, Workspace(spark, "t"))
    assert got.columns == [*odd_docs.columns, "n_lines", "n_removed"] and got.count() == odd_docs.count()
    assert line_dedup.dedup_lines(no_docs, Workspace(spark, "t")).count() == 0


def test_lines_short(spark):
    """The pipeline's stage removes equal lines of any length, but near ones of MIN_WORDS words or more only."""
    import corpus_pipeline

    rows = [(0, "All rights reserved.\none\n\nnot a near line"), (1, "one\nall  RIGHTS reserved.\ntwo\n\nnot a far line\nkept here"), (2, "one"), (3, "a b c d e\na b c d\na b c d f\na b c d")]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}
    assert got == {0: rows[0][1], 1: "two\n\nnot a far line\nkept here", 3: "a b c d e\na b c d"}


@pytest.mark.parametrize("block", [1024, 16])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 32))
    for k in range(0, 120):
        x[k] = x[k % 5] + rng.normal(size=32) * rng.choice([0.0, 0.05, 0.15])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 32), (1002, [float("nan")] + [1.0] * 31), (1003, [None] + [1.0] * 31), (1004, []), (1005, [1.0])]
    got = {r.vec_id: r for r in embed_dedup.cluster(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), Workspace(spark, "t")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in range(300))
    assert 0.9 * near.sum() <= found <= near.sum()
    want = brute_components(range(300), np.argwhere(near).tolist())
    assert sum(got[i].component_id == want[i] for i in range(300)) >= 290
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_embeddings_of_odd_lengths_and_repeated_ids(spark, monkeypatch):
    """A vector of another length changes nothing; copies count as links; entries that are dealt out still meet."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = [(k, base[k % 20].tolist()) for k in range(60)]  # three copies each
    rows += [(100, rng.normal(size=24).tolist()), (101, rng.normal(size=3).tolist()), (5, base[5].tolist()), (None, base[0].tolist())]
    for split in (embed_dedup.SPLIT, 2):
        monkeypatch.setattr(embed_dedup, "SPLIT", split)
        got = embed_dedup.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Workspace(spark, "t")).collect()
        assert len(got) == len(rows)
        by = {r.vec_id: r for r in got}
        assert all((by[k].n_links, by[k].component_id) == (2, k % 20) for k in range(60))
        assert by[100].n_links == by[101].n_links == by[None].n_links == 0


def test_span_finds_all_that_is_connected():
    rng = np.random.default_rng(9)
    codes = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for c in rng.integers(0, 1 << 62, 8).astype(np.uint64)]))
    near = [(a, b) for a in codes.tolist() for b in codes.tolist() if a < b and (a ^ b).bit_count() <= 2]
    assert brute_components(codes.tolist(), embed_dedup.span(codes, 2)) == brute_components(codes.tolist(), near)
    keys = np.repeat(np.arange(5), 80)[: len(codes)]
    got = [e for b in embed_dedup._meet(2)([pa.RecordBatch.from_arrays([pa.array(keys[k : k + 50]), pa.array(codes[k : k + 50].view(np.int64))], names=["key", "code"]) for k in range(0, len(codes), 50)]) for e in zip(*(np.array(c).view(np.uint64).tolist() for c in b.columns))]
    near = [(a, b) for (a, b) in near if keys[np.searchsorted(codes, a)] == keys[np.searchsorted(codes, b)]]
    assert brute_components(codes.tolist(), got) == brute_components(codes.tolist(), near)


def test_embeddings_recall_on_planted_links(spark):
    """Vectors among which groups don't merge, with near copies at all cosines from 0.95 on."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=(1500, 64))
    noise -= (noise * x[:1500]).sum(1, keepdims=True) * x[:1500]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.951, 1, size=(1500, 1))
    y = cos * x[:1500] + np.sqrt(1 - cos**2) * noise
    got = {r.vec_id: r for r in embed_dedup.cluster(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>"), Workspace(spark, "t")).collect()}
    assert sum(got[4000 + k].component_id == got[k].component_id for k in range(1500)) >= 0.9 * 1500
    assert len({r.component_id for r in got.values()}) >= 3990


@pytest.mark.parametrize("split", [50, 299])
def test_embeddings_of_large_table_entries(spark, split, monkeypatch):
    """Codes that meet in one large entry only are candidates, whatever number of blocks the entry is dealt into."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 16, (300, 4))
    base[:, 0] = 5  # one entry has all
    near = base ^ (1 << rng.integers(0, 5, (300, 4))) ^ (1 << rng.integers(5, 10, (300, 4)))  # two bits of three substrings
    near[:, 0] = 5 ^ (1 << rng.integers(0, 16, 300))  # and one of the first, which one table leaves out
    codes = [[sum(int(v) << (16 * k) for k, v in enumerate(r)) for r in x] for x in (base, near)]
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in sorted({*codes[0], *codes[1]})]
    monkeypatch.setattr(embed_dedup, "SPLIT", split)
    edges = embed_dedup.meetings(spark.createDataFrame(signed, "code long"), 64, Workspace(spark, "t")).collect()
    edges = [(e.a % (1 << 64), e.b % (1 << 64)) for e in edges]
    assert all((a ^ b).bit_count() <= embed_dedup.RADIUS for a, b in edges)
    root = brute_components(codes[0] + codes[1], edges)
    assert all(root[a] == root[b] for a, b in zip(*codes))


def test_embeddings_of_large_table_entries_link_as_small_ones(spark, monkeypatch):
    """A table with one entry, as a whole and dealt out."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 64))
    x[200:] = x[:200] / np.linalg.norm(x[:200], axis=1, keepdims=True) + rng.normal(size=(200, 64)) * 0.03
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embed_dedup, "masks", lambda bits, tables, places: [0])
    whole = sorted(embed_dedup.cluster(vectors, Workspace(spark, "t")).collect())
    assert sum(r.n_links for r in whole) > 200
    monkeypatch.setattr(embed_dedup, "SPLIT", 100)
    assert sorted(embed_dedup.cluster(vectors, Workspace(spark, "t")).collect()) == whole


def test_embeddings_empty(spark):
    assert embed_dedup.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"), Workspace(spark, "t")).count() == 0


def test_decontaminate(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "When John had 5 apples and Mary took 3 km away, how many apples did John have left after 5 days of work?"), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    item = bench.first().text
    docs = spark.createDataFrame([
        (0, "xx When Peter had 7 apples and Susan took 4 km away, how many apples did Peter have left after 7 days of work? yy", "q"),
        (1, "xx When Peter had 7 apples and Susan took 4 km away, how many apples did Quentin have left after 8 days of work? yy", "q"),
        (2, None, None), (3, "", "q"), (4, "one two " + item.upper() + " three", "q"), (5, "When John had 5 apples", "q"), (6, "too short", "q"), (None, item, "q"),
    ], "doc_id long, text string, leaked string")
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        decontaminate.BROADCAST_WINDOWS, before = limit, decontaminate.BROADCAST_WINDOWS
        got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(docs, bench, Workspace(spark, "t")).collect()}
        decontaminate.BROADCAST_WINDOWS = before
        assert got == {0: [1], 1: [], 2: [], 3: [], 4: [], 5: [], 6: [4], None: []} | ({4: got[4]} if got[4] in ([], [1]) else {})
    assert decontaminate.decontaminate(no_docs, bench, Workspace(spark, "t")).count() == 0
    assert decontaminate.decontaminate(odd_docs, bench.limit(0), Workspace(spark, "t")).where("leaked").count() == 0


def test_decontaminate_capitals(spark):
    """Copies whose capitals differ from the item's, in a table joined by broadcast and by a shuffle."""
    item = "After Lunch, Mary and John, Peter and Susan had 5 km left to walk, said old Quentin, and nobody in town believed that it would take 3 hours."
    other = "The seller, Anna, weighed 7 kg of apples before noon and gave the buyer, Otto, 2 coins back."
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    changed = item.upper().split()
    changed[::4] = ["CHANGED"] * len(changed[::4])
    rows = [(0, "xx " + item.upper() + " yy"), (1, item.lower()), (2, item.title()), (3, item.swapcase()), (4, other.upper() + " " + item.lower()), (5, " ".join(changed)), (6, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        decontaminate.BROADCAST_WINDOWS, before = limit, decontaminate.BROADCAST_WINDOWS
        got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(docs, bench, Workspace(spark, "t")).collect()}
        decontaminate.BROADCAST_WINDOWS = before
        assert got == {0: [1], 1: [1], 2: [1], 3: [1], 4: [1, 2], 5: [], 6: [1]}


def test_decontaminate_all_texts_short_items_and_other_names(spark):
    """Every text of an item id; short items within long texts; names of other lengths, at starts of sentences, numbers in words."""
    bench = spark.createDataFrame([
        (7, "the first text of this item talks of rivers and of bridges"), (7, "quite another text under the same id is about old maps"), (8, "capital of france paris"), (9, "yes"),
        (10, "Ann Marie has 5 apples and gives 2 apples to Bob. How many apples does Ann Marie have now?"),
    ], "item_id long, text string")
    docs = spark.createDataFrame([
        (0, "intro quite another text under the same id is about old maps outro"), (1, "we all know the capital of France Paris is large and old"), (2, "yes"), (3, "yes we can"),
        (4, "Once more. Tom has seven apples and gives three apples to Mary Sue. How many apples does Tom have now? Good."),
        (5, "Tom has seven apples and gives three apples to Mary Sue. How many apples does Peter have now?"), (6, "capital of italy rome"),
    ], "doc_id long, text string")
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        decontaminate.BROADCAST_WINDOWS, before = limit, decontaminate.BROADCAST_WINDOWS
        got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(docs, bench, Workspace(spark, "t")).collect()}
        decontaminate.BROADCAST_WINDOWS = before
        assert got == {0: [7], 1: [8], 2: [9], 3: [], 4: [10], 5: [], 6: []}
