"""Line dedup, near-duplicates, sharding and passages against plain versions; the pipeline; empty tables."""

import hashlib
import random
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_text_operators import LOWER, PIECE, WORD, plain_hits, plain_quality, split

from quarry.llm import bpe, components, decontam, licenses, line_dedup, lm, minhash, repetition, sharding, substring, token_counts

REPO = Path(__file__).resolve().parents[2]


def plain_lines(rows, least=20, docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                held[key(x)].add(i)
    common = {k: max(v) for k, v in held.items() if len(k) >= least and len(v) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or common.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_line_dedup(edge, small, batches):
    for docs in (edge, small):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = line_dedup.line_dedup(docs, batches=batches)
        assert Counter(map(tuple, got.collect())) == Counter(plain_lines(rows))


def test_line_dedup_of_text_ids(spark):
    line = "a line of more than twenty characters"
    docs = spark.createDataFrame([("b", line), ("a", line + "\nown"), ("c", line), (None, line)], "doc_id string, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {"a": ("own", 1), "b": ("", 1), "c": (line, 0), None: (line, 0)}


def test_percent_is_refused_below_80(small):
    with pytest.raises(ValueError):
        minhash.near_duplicates(small, percent=75)


def test_runs_are_anti_joined(spark):
    runs = line_dedup.LineRuns(fanout=3)
    frame = lambda *rows: spark.createDataFrame(rows, "h1 long, h2 long, doc_id long")
    first = runs.add(frame((1, 1, 9), (1, 1, 9), (2, 2, 9), (2, 2, 8)))
    second = runs.add(frame((1, 1, 5), (3, 3, 5)))
    assert sorted(map(tuple, first.collect())) == [(1, 1, 1, 9), (2, 2, 2, 9)]
    assert sorted(map(tuple, second.collect()), key=str) == [(1, 1, 1, None), (3, 3, 1, 5)]
    assert sorted(map(tuple, runs.total().collect())) == [(1, 1, 2, 9), (2, 2, 2, 9), (3, 3, 1, 5)]
    runs.add(frame((2, 2, 3)))
    assert [len(level) for level in runs.levels] == [0, 1]
    assert sorted(map(tuple, runs.total().collect())) == [(1, 1, 2, 9), (2, 2, 3, 9), (3, 3, 1, 5)]


def plain_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = split((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) or rows[a][0] == rows[b][0] and sets[a] and sets[b]:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least[find(k)] if i is not None else None, i is None or least[find(k)] == i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("size", "short"), [(2, 32), (2, 1), (5, 32)])
def test_near_duplicates(edge, small, size, short):
    for docs in (edge, small):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = minhash.near_duplicates(docs, shingle=size, percent=80, short_list=short)
        assert Counter(map(tuple, got.collect())) == Counter(plain_components(rows, size, 80))


def test_groups_of_near_copies(spark):
    """Stragglers that are linked to a copy but not to the hub are found."""
    rng = random.Random(5)
    base = [f"v{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(140):
        copy = list(base)
        for _ in range(rng.choice((0, 2, 5, 8, 12))):
            copy[rng.randrange(30)] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(plain_components(rows, 2, 80))
    assert len({c for _, _, c, _ in want}) > 1
    assert Counter(map(tuple, minhash.near_duplicates(docs, shingle=2, percent=80, short_list=8).collect())) == want


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, pairs):
    edges = spark.createDataFrame(pairs, "u long, v long")
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for u, v in pairs:
            label[u] = label[v] = min(label[u], label[v])
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {x: c for x, c in label.items() if x != c}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=14), st.integers(1, 6))
def test_minimax_cuts(sizes, shards):
    capacity, cuts = sharding.minimax_cuts(sizes, shards)
    prefix = [0]
    for x in sizes:
        prefix.append(prefix[-1] + x)
    bounds = [0, *cuts, len(sizes)]
    assert len(cuts) == shards - 1 and bounds == sorted(bounds)
    assert max(prefix[b] - prefix[a] for a, b in zip(bounds, bounds[1:], strict=False)) <= capacity
    best = [0] + [sum(sizes) + 1] * len(sizes)
    for k in range(shards):
        best = [0] + [min(max(best[j], prefix[i] - prefix[j]) if k else prefix[i] for j in range(i + 1)) for i in range(1, len(sizes) + 1)]
    assert capacity == (best[-1] if sizes else 0)


@pytest.mark.parametrize(("n", "hot", "bits"), [(400, 0, 2), (400, 9000, 2), (5, 0, 16), (60, 300, 4), (0, 0, 16)])
def test_cuts_are_exact_over_groups(spark, monkeypatch, n, hot, bits):
    monkeypatch.setattr(sharding, "CELL_BITS", bits)
    monkeypatch.setattr(sharding, "STEP_BITS", 3)
    rng = random.Random(n + hot)
    groups = {rng.randrange(1 << 64) if i % 3 else (0xABC << 52) + rng.randrange(1 << 20): rng.randrange(1, 60) for i in range(n)}
    if hot:
        groups[rng.choice(list(groups))] = hot
    rows = spark.createDataFrame([(h - (1 << 64) if h >> 63 else h, x) for h, x in groups.items()], "h long, size long")
    order = sorted(groups)
    want, _ = sharding.minimax_cuts([groups[h] for h in order], 8)
    cuts = sharding.group_cuts(rows, 8)
    assert len(cuts) == (7 if n else 0) or not n
    loads = [0] * 8
    for h in order:
        loads[sum(h >= c for c in cuts)] += groups[h]
    assert max(loads) == want


def test_sharding(edge, spark):
    got = sharding.shard(edge, shards=4).collect()
    rows = edge.select("doc_id", "text").collect()
    import zlib

    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= {0, 1, 2, 3} and all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_text = defaultdict(set)
    for r in got:
        by_text[r.size, r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_passages(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(60)
    fuzzy = [("edited" if i in (20, 41) else w) for i, w in enumerate(passage)]
    texts = [fresh(50) + passage + fresh(40), fresh(10) + passage + fresh(5), fresh(30) + fuzzy + fresh(30), fresh(200), fresh(30) + passage[:20] + fresh(30), fresh(80), None, "", "loop it " * 60, "loop it " * 70]
    rows = [(i, " ".join(t) if isinstance(t, list) else t) for i, t in enumerate(texts)] + [(50, " ".join(texts[5])), (None, " ".join(texts[5])), (5, " ".join(texts[5]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in substring.repeated_passages(docs).collect():
        got[r.doc_id] = (r.n_passage_words, list(r.spans), list(r.partners), r["first"])
    assert got[0] == (60, [50, 110], [], True) and got[1] == (60, [10, 70], [0], False) and got[2] == (60, [30, 90], [0], False)
    assert got[3][0] == got[4][0] == got[6][0] == got[7][0] == got[None][0] == 0
    assert got[5] == (80, [0, 80], [], True) and got[50] == (80, [0, 80], [5], False)
    assert got[8][0] > 100 and got[9][2] == [8]


def _passages(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in substring.repeated_passages(docs).collect()}


def test_fuzzy_passages_are_seeded(spark):
    """Copies of 50 words with every eighth or sixth word changed."""
    rng = random.Random(5)
    fresh = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for n in range(40):
        passage = fresh(50)
        step = 6 if n % 2 else 8
        texts += [fresh(50) + passage + fresh(50), fresh(50) + [f"e{i}" if i % step == 3 else w for i, w in enumerate(passage)] + fresh(50)]
    got = _passages(spark, texts)
    assert sum(got[2 * n + 1]["first"] for n in range(40)) <= 2


def test_passages_whose_seeds_have_other_hubs(spark):
    """Each stretch of nine words of a passage stands in ten smaller ids of its own."""
    rng = random.Random(6)
    fresh = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(60)
    texts = [fresh(40) + passage[i : i + 9] + fresh(40) for i in range(0, 58, 3) for _ in range(10)]
    texts += [fresh(30) + passage + fresh(30), fresh(20) + passage + fresh(40)]
    got = _passages(spark, texts)
    a, b = len(texts) - 2, len(texts) - 1
    assert got[a].n_passage_words == got[b].n_passage_words == 60 and list(got[b].partners) == [a]


@pytest.mark.parametrize("stretch", [9, 34])
def test_edited_passages_whose_seeds_have_other_hubs(spark, stretch):
    """No run of 40 words is left, and each stretch (of 34 words: each pair of seeds too) stands in ten smaller ids."""
    rng = random.Random(16)
    fresh = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(70)
    edited = [("edited" if i in (23, 47) else w) for i, w in enumerate(passage)]
    texts = [fresh(40) + passage[i : i + stretch] + fresh(40) for i in range(0, 70 - stretch + 3, 3) for _ in range(10)]
    texts += [fresh(30) + passage + fresh(30), fresh(20) + edited + fresh(40)]
    got = _passages(spark, texts)
    a, b = len(texts) - 2, len(texts) - 1
    assert got[a].n_passage_words == got[b].n_passage_words == 70 and list(got[b].partners) == [a]


def test_wide_links_by_plain_loops():
    """In any pieces, each open row meets the first texts of its key, then all others."""
    import numpy as np

    rng = random.Random(17)
    rows = sorted((key, rep, rep % 7, x, x + 20, rng.choice([substring.NONE, rep % 7 - 1, 0])) for key in range(40) for rep in rng.sample(range(25), rng.randrange(1, 12)) for x in rng.sample(range(50), rng.randrange(1, 3)))
    found = {}
    for size in (3, 10**6):
        batches = lambda: (tuple(np.array(c) for c in zip(*rows[i : i + size], strict=True)) for i in range(0, len(rows), size))  # noqa: B023, E731
        found[size] = [{p for f in substring.wide_links(batches(), 4, whole) for p in zip(*(c.tolist() for c in f), strict=True)} for whole in (False, True)]
    assert found[3] == found[10**6]
    for whole in (False, True):
        want = set()
        for key in range(40):
            group = [r for r in rows if r[0] == key]
            first = [r for i, r in enumerate(group) if i == 0 or group[i - 1][1] != r[1]]
            others = first[4:] if whole else first[:4]
            least = min((r[2] for r in others), default=0)
            for r in group:
                if r[5] > least and (r[2] > least or r[5] == substring.NONE):
                    for t in others:
                        if t[2] != r[2]:
                            a, b = (r, t) if r[1] > t[1] else (t, r)
                            want.add((a[1], b[1], a[3], a[4], b[3], b[4]))
        assert found[3][whole] == want and want


def test_runs_of_one_word_make_few_links():
    """Sixty texts with a run of one frequent word, too short for a passage: a few links a pair, none of them lost."""
    import numpy as np

    rng = random.Random(18)
    texts = [np.array([rng.randrange(2**32) for _ in range(50)], dtype=np.uint64) for _ in range(60)]
    for h in texts:
        h[10 : 10 + rng.randrange(28, 38)] = 7
    rows = []
    for rep, h in enumerate(texts):
        _, seeds, at = substring.batch_seeds([h], 3, 6)
        order = np.lexsort((seeds, at))
        key, x, y, head, upto = substring.wide_seeds(at[order], seeds[order].view(np.int64), 3)
        by = substring.covering(x, upto, [])
        rows += zip(*(c.tolist() for c in (key, np.full(len(key), rep), np.full(len(key), rep), x, y, by, head)), strict=True)
    batch = tuple(np.array(c) for c in zip(*sorted(rows), strict=True))
    found = {whole: set().union(*(zip(*(c.tolist() for c in p), strict=True) for p in substring.places_met(substring.wide_links(iter([batch]), 8, whole)))) for whole in (False, True)}
    links = found[False] | found[True]
    assert {(r, h) for r, h, _, _ in links} == {(r, h) for r in range(60) for h in range(r)}
    assert len(links) <= 8 * 60 * 59 / 2


def test_loops_are_covered_to_their_ends(spark):
    """Runs of one frequent word: any 40 words of the longest stand in the others."""
    rng = random.Random(19)
    fresh = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    sizes = [30] * 10 + [76, 41, 45, 55] + [94, 130, 33]
    got = _passages(spark, [fresh(20) + ["the"] * n + fresh(30) for n in sizes])
    assert [list(got[i].spans) for i in range(len(sizes))] == [[20, 20 + n] if n >= 40 else [] for n in sizes]


@pytest.mark.parametrize("twice", [0, 1, 2])
def test_passages_that_stand_twice_in_a_document(spark, twice):
    rng = random.Random(7)
    fresh = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(60)
    texts = [fresh(30) + passage + fresh(30) + (passage + fresh(10) if i == twice else []) for i in range(3)]
    got = _passages(spark, texts)
    assert [got[i].n_passage_words for i in range(3)] == [120 if i == twice else 60 for i in range(3)]


def test_passages_whose_pieces_stand_in_smaller_ids(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(90)
    texts = [fresh(30) + passage[i * 10 : i * 10 + 20] + fresh(30) for i in range(8)] * 1
    texts += [fresh(30) + passage + fresh(30), fresh(20) + passage + fresh(40)]
    got = _passages(spark, texts)
    assert got[8].n_passage_words == got[9].n_passage_words == 90 and list(got[9].partners) == [8]


def test_passages_of_an_id_with_several_texts(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    passage, own = fresh(60), fresh(70)
    texts = [(1, fresh(50) + own), (1, own + fresh(10) + passage + fresh(20)), (1, fresh(90)), (2, fresh(20) + passage + fresh(30)), (3, passage), (3, fresh(5) + passage)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_passage_words, tuple(r.partners), r["first"]) for r in substring.repeated_passages(docs).collect())
    assert got == [(1, 90, 0, (), True), (1, 120, 0, (), True), (1, 160, 60, (), True), (2, 110, 60, (1,), False), (3, 60, 60, (1,), False), (3, 65, 60, (1,), False)]


def test_passages_of_a_table_by_brute_force(small):
    """Every run of 40 words that another id has too lies in a document's spans, and spans hold passages only."""
    least = 40
    rows = [(r.doc_id, tuple(split(r.text.translate(LOWER)))) for r in small.select("doc_id", "text").collect() if r.text]
    holders = {}
    for i, w in rows:
        for k in range(len(w) - least + 1):
            holders.setdefault(hash(w[k : k + least]), set()).add(i)
    found = {r.doc_id: r for r in substring.repeated_passages(small).collect()}
    copied = Counter(w for _, w in rows)
    exact = all_words = 0
    for i, w in rows:
        want = {p for k in range(len(w) - least + 1) if len(holders[hash(w[k : k + least])]) > 1 for p in range(k, k + least)}
        have = {p for a, b in zip(found[i].spans[::2], found[i].spans[1::2], strict=True) for p in range(a, b)}
        assert want <= have, (i, len(want - have))
        assert len(have) == found[i].n_passage_words
        exact, all_words = exact + len(want), all_words + len(have)
        assert copied[w] == 1 or len(w) < least or have == set(range(len(w)))
    assert 0 < exact <= all_words


def test_links_in_pieces():
    """A seed that runs over many batches is linked as in one; the few documents of another are linked in pairs."""
    import numpy as np

    seed = np.array([1] * 12 + [2] * 250_000 + [3] * 2)
    rep = np.concatenate([np.arange(12) // 3, np.arange(250_000) // 2, [7, 8]])
    pos = np.arange(len(seed))
    whole = lambda size: set().union(*(set(zip(*(c.tolist() for c in found[:4]), strict=True)) for found in substring.links(((seed[i : i + size], rep[i : i + size], pos[i : i + size]) for i in range(0, len(seed), size)), 8)))
    one, many = whole(10**6), whole(7_001)
    assert {(r, h) for r, _, h, _ in one if r < 4 and h < 4 and _ < 12} >= {(r, h) for r in range(4) for h in range(r)}
    assert {x for x in one if x[0] != 0} == {x for x in many if x[0] != 0}


def test_chains_over_foreign_words_are_cut():
    shared, other = list(range(50)), list(range(100, 145))
    a, b = shared + list(range(1000, 1060)) + other, shared + list(range(2000, 2020)) + other
    seeds = [(i, i) for i in range(0, 45, 9)] + [(110 + i, 70 + i) for i in range(0, 40, 9)]
    assert substring.passages_of(a, b, seeds, 5, 12, 40, 0.8) == [(0, 50, 0, 50), (110, 155, 70, 115)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=14, unique=True))
def test_chains(points):
    import numpy as np

    points.sort()
    x, y = (np.array(c) for c in zip(*points, strict=True))
    found = substring.chains(x, y, 5, 0.1)
    assert sorted(s for c in found for s in c) == list(range(len(points)))
    for c in found:
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:], strict=False))
    best = []
    for s in range(len(points)):
        best.append(5 + max([0.0, *(best[r] - 0.1 * (x[s] - x[r] + y[s] - y[r]) for r in range(s) if x[r] < x[s] and y[r] < y[s])]))
    score = 5 * len(found[0]) - 0.1 * (x[found[0][-1]] - x[found[0][0]] + y[found[0][-1]] - y[found[0][0]])
    assert score == pytest.approx(max(best))


def test_empty_tables(none, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    for found in (
        bpe.bpe_encode(none, WORD), token_counts.token_counts(none, PIECE), line_dedup.line_dedup(none), lm.score(none, PIECE), repetition.quality(none), minhash.near_duplicates(none),
        licenses.license_scan(none), sharding.shard(none), decontam.decontaminate(none, bench), substring.repeated_passages(none),
    ):
        assert found.columns[0] == "doc_id" and found.count() == 0


def test_empty_benchmark(edge, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(edge, bench).where("n_hit > 0").count() == 0


def plain_pipeline(rows, items):
    """The stages over (id, text) with plain versions of each operator; ids are unique and not null."""
    rows = [r for r in rows if plain_quality(r[1])[-1]]
    rows = [(i, t) for i, t, _, _ in plain_lines(rows)]
    rows = [r for r, (_, _, _, kept) in zip(rows, plain_components(rows, 5, 80), strict=True) if kept]
    clean = []
    for i, t in rows:
        n, hit, _ = plain_hits(t, items)
        if not hit or 20 * len(hit) < n:
            clean.append((i, t))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    out = Counter()
    for i, t in clean:
        ids = library.encode(t, add_special_tokens=False).ids
        out[i, len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    return out


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got.collect()) == plain_pipeline(rows, items)


def test_stages_keep_columns(spark, edge, none):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for docs in (edge, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()


def test_entry_works_without_this_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "quarry"):
        subprocess.run(["cp", "-r", str(REPO / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quarry/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
