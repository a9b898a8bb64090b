"""BPE, token counts, language model, quality rules, licenses and decontamination against plain versions."""

import hashlib
import itertools
import math
import pickle
import random
import re
import unicodedata
import zlib
from array import array
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bpe, decontam, licenses, lm, repetition, token_counts
from quarry.llm.tokenizers import PIECE_BPE, WORD_BPE, tokenizer_file
from quarry.llm.unigram import Lattice, vocabulary

WORD, PIECE = tokenizer_file(WORD_BPE), tokenizer_file(PIECE_BPE)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_bpe_is_the_librarys(edge, small):
    library = Tokenizer.from_file(WORD)
    for docs in (edge, small):
        given_ = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        want = Counter()
        for (i, t), n in given_.items():
            ids = library.encode(t or "", add_special_tokens=False).ids
            want[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += n
        encoded = bpe.bpe_encode(docs, WORD)
        assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in encoded.collect()) == want
        assert all(r.n_tokens == len(r.ids) for r in encoded.collect())
        again = bpe.bpe_decode(encoded.select("doc_id", "ids"), WORD)
        assert Counter(map(tuple, again.collect())) == Counter((r.doc_id, r.decoded) for r in encoded.collect())


def test_every_code_point_and_mixed_marks_are_the_librarys():
    library = Tokenizer.from_file(WORD)
    with open(WORD, "rb") as f:
        mine = bpe.BpeTokenizer(pickle.loads(pickle.dumps(bpe.compile_bpe(f.read()))), cache_limit=1000)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in points if unicodedata.combining(chr(c))]
    rng = random.Random(1)
    texts = [f"a{chr(c)}b" for c in points]
    texts += ["".join(chr(rng.choice(marks if rng.random() < 0.5 else points[:0x20000])) for _ in range(8)) for _ in range(20_000)]
    texts += ["x" * 5000, "ab" * 3000 + "</w>", "\U00011935\U00011930", "don't'll <|endoftext|>'s"]
    for k in range(0, len(texts), 50_000):
        part = texts[k : k + 50_000]
        for t, e in zip(part, library.encode_batch(part, add_special_tokens=False), strict=True):
            assert array("i", mine.encode_bytes(t.encode())[0]).tolist() == e.ids, ascii(t)


def naive_bpe(symbols, ranks):
    """Merges the pair of least rank, leftmost first, until none is left."""
    symbols = list(symbols)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(itertools.pairwise(symbols)) if p in ranks]
        if not found:
            return symbols
        i = min(found)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=14), st.text("ab", min_size=1, max_size=24))
def test_automaton_accepts_just_the_merged_sequence(picks, text):
    tokens, merges, ranks = ["a", "b"], [], {}
    for x, y in picks:
        u, v = tokens[x % len(tokens)], tokens[y % len(tokens)]
        if u + v not in tokens:
            ranks[u, v] = len(merges)
            merges.append((tokens.index(u), tokens.index(v), len(tokens)))
            tokens.append(u + v)
    automaton = bpe.MergeAutomaton(merges)
    found = []

    def walk(at, path):
        if at == len(text):
            found.append([tokens[t] for t in path])
        for t, token in enumerate(tokens):
            if text.startswith(token, at) and (not path and t not in automaton.dead or path and automaton.follows(path[-1], t)):
                walk(at + len(token), [*path, t])

    walk(0, [])
    assert found == [naive_bpe(text, ranks)]


def test_token_counts(edge):
    pieces, scores = vocabulary(PIECE)
    best = {}
    for p, x in zip(pieces, scores, strict=True):
        best[p] = max(x, best.get(p, -math.inf))

    def count(word):
        s = b" " + word.encode()
        at = [(0.0, 0)] + [(-math.inf, 0)] * len(s)
        for j in range(1, len(s) + 1):
            at[j] = max(((at[i][0] + best[s[i:j]], at[i][1] - 1) for i in range(max(0, j - 60), j) if s[i:j] in best), default=at[j])
        return -at[-1][1]

    want = Counter((r.doc_id, len(split(r.text)), sum(map(count, split(r.text)))) for r in edge.select("doc_id", "text").collect())
    got = Counter((r.doc_id, r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(edge, PIECE).collect())
    assert got == want
    counter = token_counts.TrieCounter(pieces, scores)
    counter.count({b"walking", b"walked", b"walk"})
    assert counter.steps == len(b" walk") + len(b"ed") + len(b"ing")  # shared prefixes are computed once


def test_forward_sums_all_segmentations():
    pieces = [b" a", b" ", b"a", b"b", b"ab", b" ab"]
    p = [0.1, 0.2, 0.05, 0.15, 0.3, 0.2]

    def total(s):
        return 1.0 if not s else sum(q * total(s[len(x) :]) for x, q in zip(pieces, p, strict=True) if s.startswith(x))

    lattice = Lattice(pieces, [math.log(x) for x in p])
    for word in (b"a", b"ab", b"abab", b"aabba"):
        assert math.isclose(math.exp(lattice.forward(word)), total(b" " + word), rel_tol=1e-9)
        counts = [0.0] * len(pieces)
        lattice.expect(word, 2.0, counts)
        assert math.isclose(sum(len(x) * c for x, c in zip(pieces, counts, strict=True)), 2 * (len(word) + 1), rel_tol=1e-9)


def test_language_model(edge):
    rows = edge.select("doc_id", "text").collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train, ends = Counter(), 0
    for r in rows:
        if not out(r.doc_id):
            train.update(split((r.text or "").translate(LOWER)))
            ends += 1
    total, kinds = sum(train.values()) + ends, len(train) + 1
    base = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    pieces, prior = vocabulary(PIECE)
    uses = [0.0] * len(pieces)
    lattice = Lattice(pieces, prior)
    for w, c in train.items():
        lattice.expect(w.encode(), c, uses)
    mass = sum(uses) + ends + 0.5 * (len(pieces) + 1)
    fitted = Lattice(pieces, [math.log((x + 0.5) / mass) for x in uses])
    want = []
    for r in rows:
        ws = split((r.text or "").translate(LOWER))
        s = sum(fitted.forward(w.encode()) for w in ws) / math.log(10) + math.log10((ends + 0.5) / mass)
        want.append((-1 if r.doc_id is None else r.doc_id, out(r.doc_id), len(ws) + 1, sum(train[w] > 0 for w in ws) + 1, total, round(sum(base(train[w]) for w in ws) + base(ends), 6), round(s, 5)))
    for head in (0, 5, 10**6):  # all words by the join, some by either way, all broadcast
        got = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 5)) for r in lm.score(edge, PIECE, head_words=head).collect()]
        assert sorted(got) == sorted(want)


def plain_quality(t):
    w = split(t)
    n = len(w)
    text = t or ""
    longest = [0] * n
    where = {}
    for i, x in enumerate(w):
        where.setdefault(x, []).append(i)
    for i in range(n):
        for j in where[w[i]]:
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    cover = lambda least, length: len({p for i in range(n) if longest[i] >= least for p in range(i, i + (length or longest[i]))})
    lines = [x for x in text.split("\n") if split(x)]
    counts = (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), cover(3, 3), cover(repetition.MIN_REPEAT, 0), max(longest, default=0))
    failed = n < 50 or 100 * counts[5] > 50 * n
    kept = not failed and 100 * counts[6] <= repetition.MAX_COVERED * n and 100 * counts[7] <= repetition.MAX_LONGEST * n
    kept = kept and 100 * counts[2] <= repetition.MAX_SYMBOLS * counts[1] and 100 * counts[4] <= repetition.MAX_DUP_LINES * counts[3]
    return (*counts, failed, kept)


def test_quality(edge, small):
    for docs in (edge.where("length(text) < 6000 OR text IS NULL"), small.where("length(text) < 6000")):
        rows = docs.select("doc_id", "text").collect()
        got = repetition.quality(docs).collect()
        assert Counter(map(tuple, got)) == Counter((r.doc_id, *plain_quality(r.text)) for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab \n#é", max_size=60), min_size=1, max_size=6))
def test_many_texts_at_once(texts):
    m = repetition.measure([t.encode() for t in texts], 2)
    for k, t in enumerate(texts):
        repetition_of_one = repetition.measure([t.encode()], 2)
        assert all(int(m[c][k]) == int(repetition_of_one[c][0]) for c in repetition.COUNTS)


def plain_hits(text, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, named = words(text), set(), set()
    for item, body in items:
        b = words(body)
        for k in range(max(1, len(b) - size + 1) if b else 0):
            win = b[k : k + size]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    if item is not None:
                        named.add(str(item))
    return len(w), hit, sorted(named)


ITEMS = [(1, "the shared LINE is"), (2, "w1"), (10, " ".join(f"w{i}" for i in range(20))), (3, None), (4, ""), (5, "!!"), (None, "one two"), (7, "same words here " * 9), (7, "mixed")]


@pytest.mark.parametrize("limit", [1 << 25, 64])
def test_decontamination(spark, edge, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.decontaminate(edge, items, benchmark_bytes=limit)
    want = Counter()
    for r in edge.select("doc_id", "text").collect():
        n, hit, named = plain_hits(r.text, ITEMS)
        want[r.doc_id, n, len(hit), tuple(named)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == want
    clean = decontam.keep_clean(edge, items, benchmark_bytes=limit)
    assert clean.columns == edge.columns
    kept = Counter({(i, n, h, x): c for (i, n, h, x), c in want.items() if not h or 20 * h < n})
    assert Counter(r.doc_id for r in clean.select("doc_id").collect()) == Counter(i for (i, *_), c in kept.items() for _ in range(c))
    kept = decontam.keep_clean(edge, items, benchmark_bytes=limit)
    clean = [tuple(r) for r in edge.collect() if not (h := plain_hits(r.text, ITEMS))[1] or 20 * len(h[1]) < h[0]]
    assert kept.columns == edge.columns and Counter(map(tuple, kept.collect())) == Counter(clean)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=5), max_size=6), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40))
def test_wu_manber(patterns, text):
    search = decontam.WuManber({tuple(p): {i} for i, p in enumerate(patterns)})
    spans, items = search.find(text)
    want = {(i, i + len(p)) for p in patterns for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p}
    assert set(spans) == want and len(spans) == len(want)
    assert {tuple(patterns[i]) for i in items} == {tuple(text[a:b]) for a, b in want}


def test_licenses(edge):
    found = {r.doc_id: r for r in licenses.license_scan(edge).where("license IS NOT NULL").collect()}
    assert set(found) == {23} and found[23].license == "CC-BY-NC-4.0" and "MIT" in found[23].licenses
    assert found[23].coverage == 1.0 and (found[23].start, found[23].end) == (0, 7)
    scanner = licenses.LicenseScanner(licenses.NOTICES, 0.85)
    text = "Some license words. " * 5 + "This work is, since 2001, licensed under the GNU General Public License (version 3)."
    assert scanner.scan(text.encode())[0][0] == "GPL-3.0"
    assert scanner.scan(b"a license is not a notice, and general public notices are no license version") == []


def test_notices_away_from_their_rarest_words():
    scanner = licenses.LicenseScanner([*licenses.NOTICES.items(), *licenses.TEXTS.items()], 0.85)
    passage = "use of this source code is ruled by a style license that can be found in the license file"
    text = "governed bsd " + "filler words go here " * 30 + passage
    assert [f[0] for f in scanner.scan(text.encode())] == ["BSD-3-Clause"]
    for name, body in licenses.TEXTS.items():
        words = body.split()
        for step in (9, 12):
            edited = " ".join("other" if i % step == 4 else w for i, w in enumerate(words))
            found = scanner.scan(("The preface of the file, with any words of a license. " * 4 + edited + " the rest is of no use").encode())
            assert name in [f[0] for f in found], (name, step)
    assert scanner.scan(licenses.TEXTS["MIT"].encode() * 3)[0][:2] == ("MIT", 1.0)


def plain_licenses(text, notices, coverage):
    """The best alignment over all windows that start with a word of the notice."""
    words, best = decontam.bench_words(text), {}
    for name, notice in notices:
        notice = decontam.bench_words(notice.encode())
        size = len(notice) + len(notice) // 2
        for s in range(len(words)):
            matched = licenses.patience_align(words[s : s + size], notice) if words[s] in notice else []
            if len(matched) >= coverage * len(notice) - 1e-9 and len(matched) > 0:
                got = (len(matched) / len(notice), len(notice), -(s + matched[0][0]), -(s + matched[-1][0] + 1))
                old = best.get(name, (0.0, 0))
                best[name] = max(old, got) if old[:2] != got[:2] else old
    return [(n, b[0], -b[2], -b[3]) for n, b in sorted(best.items(), key=lambda f: (-f[1][0], -f[1][1], f[0]))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefg"), min_size=1, max_size=8), min_size=1, max_size=3), st.lists(st.sampled_from("abcdefgh"), max_size=40), st.sampled_from([0.5, 0.75, 0.85, 1.0]))
def test_licenses_by_brute_force(notices, text, coverage):
    pairs = [(f"n{i}", " ".join(n)) for i, n in enumerate(notices)]
    body = " ".join(text).encode()
    assert licenses.LicenseScanner(pairs, coverage).scan(body) == plain_licenses(body, pairs, coverage)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=12), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=12))
def test_patience_alignments_are_common_subsequences(a, b):
    pairs = licenses.patience_align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in itertools.pairwise(pairs))
    if a == b:
        assert len(pairs) == len(a)


def test_digest(edge):
    r = bpe.bpe_encode(edge, WORD).where("doc_id = 1").first()
    assert hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
