"""BPE encoding and decoding by a token automaton built from merge gadgets.

The automaton reads *tokens*. It starts as one state with a loop for every base symbol, so that every
string of base symbols is accepted, and is then changed once for each merge ``u v -> w``, in order of
rank, by the merge gadget: wherever ``u`` leads to a state with an arc ``v``, an arc ``w`` is added past
both, and ``u`` is led to a copy of that state which lacks ``v``. What remains accepted is exactly the
set of correctly merged token sequences, one for each string.

All arcs labelled with one token end in one state, so a state is named by the token last read. A copy
differs from its original by one missing arc, so the compiled table holds, for each state, the state it was
copied from and when, and for each missing arc the merge that took it away: three arrays over tokens and one
over merges. They are compiled once, on the driver, and sent to the workers as they are.

Encoding walks a word's symbols through the arcs; at each place exactly one accepted token ends, so the walk
is deterministic, never goes back and needs no priority queue of merges. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import kept_by, slices, text_bytes, values

_FOREVER = (1 << 31) - 1

#: Code points that the pattern package counts as letters and the vocabulary's tokenizer does not.
LATER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
    "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: The same for numbers.
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: Marks that Python's NFC reorders or composes and the tokenizer's, which is older, leaves in place.
LATER_MARKS = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 "
    "10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 "
    "16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
#: First and last capital, distance to the small letter and step, where the tokenizer lower-cases and Python does not.
LATER_CAPITALS = (
    (0x1C89, 0x1C89, 1, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB, 1), (0xA7CC, 0xA7CE, 1, 2), (0xA7D2, 0xA7D4, 1, 2), (0xA7DA, 0xA7DA, 1, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC, 1), (0x10D50, 0x10D65, 0x20, 1), (0x16EA0, 0x16EB8, 0x1B, 1),
)


def _points(ranges: str) -> str:
    """The inside of a pattern's class: ranges of code points."""
    return "".join("-".join(rf"\U{int(p, 16):08X}" for p in r.split("-")) for r in ranges.split())


LETTER, NUMBER = (rf"[\p{{{kind}}}--[{_points(later)}]]" for kind, later in (("L", LATER_LETTERS), ("N", LATER_NUMBERS)))
_MARKS = re.compile(f"([{_points(LATER_MARKS)}])")
_SMALL = {c: c + off for first, last, off, step in LATER_CAPITALS for c in range(first, last + 1, step)} | {0x3A3: 0x3C3}


def normalised(text: str) -> str:
    """NFC as the tokenizer has it: marks that its tables lack stand apart from what is around them."""
    if _MARKS.search(text) is None:
        return unicodedata.normalize("NFC", text)
    return "".join(p if k % 2 else unicodedata.normalize("NFC", p) for k, p in enumerate(_MARKS.split(text)))


class MergeAutomaton:
    """Deterministic automaton over token ids of a ranked merge list.

    ``merges`` holds ``(left id, right id, merged id)`` in order of rank. Tokens that no merge makes are symbols.
    """

    def __init__(self, merges: Iterable[tuple[int, int, int]], table_limit: int = 120_000):
        merges = list(merges)
        self.size = 1 + max((max(m) for m in merges), default=0)
        self.born = array("i", [_FOREVER]) * self.size
        self.left, self.right = (array("i", [-1]) * self.size for _ in range(2))
        #: Rank of the merge that took an arc away, by state * size + token.
        self.gadget: dict[int, int] = {}
        self.dead: set[int] = set()
        self.table: dict[int, bool] = {}
        self.table_limit = table_limit
        for rank, (u, v, w) in enumerate(merges):
            if self.left[w] >= 0:
                raise ValueError(f"token {w} is made by two merges")
            # A merge whose right part can no longer follow its left part never applies: it adds no arc.
            if self._resolve(u, v):
                self.gadget[u * self.size + v] = rank
            else:
                self.dead.add(w)
            self.born[w], self.left[w], self.right[w] = rank, u, v

    def __getstate__(self) -> dict:
        gadget = (np.fromiter(self.gadget, np.int64, len(self.gadget)), np.fromiter(self.gadget.values(), np.int32, len(self.gadget)))
        return self.__dict__ | {"gadget": gadget, "table": {}}

    def __setstate__(self, state: dict) -> None:
        keys, ranks = state["gadget"]
        self.__dict__ |= state | {"gadget": dict(zip(keys.tolist(), ranks.tolist(), strict=True))}

    def _resolve(self, last: int, token: int) -> bool:
        """Whether the state after ``last`` has an arc ``token``, by the chain of copies on both sides."""
        born, left, right, gadget, size = self.born, self.left, self.right, self.gadget, self.size
        if token in self.dead:
            return False
        if last >= size or token >= size:
            return True  # in no merge
        spine, until, t = [], _FOREVER, token
        while True:
            spine.append((t, until))
            if left[t] < 0:
                break
            until, t = born[t], left[t]
        state, before = last, _FOREVER
        while True:
            row = state * size
            for t, until in spine:
                # ``until`` counts itself: the copy that lacks ``u`` gets no arc ``uu`` from the merge ``u u``.
                rank = gadget.get(row + t, _FOREVER)
                if rank < before and rank <= until:
                    return False
            if left[state] < 0:
                return True
            before, state = born[state], right[state]

    def follows(self, last: int, token: int) -> bool:
        """Is there an arc ``token`` after ``last``? Arcs that were asked for are remembered."""
        key = (last << 32) + token
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= self.table_limit:
                self.table.clear()
            found = self.table[key] = self._resolve(last, token)
        return found


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in shown):
        shown[b] = chr(256 + k)
    return [shown[b] for b in range(256)]


@dataclass
class CompiledBpe:
    """What one ``tokenizer.json`` compiles to: the automaton, its labels, and how texts are normalised and split."""

    automaton: MergeAutomaton
    labels: list[bytes]
    #: Tokens by the bytes that they stand for, inside a word and (where the vocabulary marks it) at its end.
    inner: dict[bytes, int] = field(default_factory=dict)
    final: dict[bytes, int] = field(default_factory=dict)
    special: dict[str, int] = field(default_factory=dict)
    nfc: bool = False
    lowercase: bool = False
    pattern: str = ""


def compile_bpe(source: bytes) -> CompiledBpe:
    """Compiles a ``tokenizer.json`` with byte-level BPE, with an end-of-word suffix or without."""
    spec = json.loads(source)
    model = spec["model"]
    if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback"):
        raise ValueError("only byte-level BPE vocabularies are supported")
    vocab: dict[str, int] = model["vocab"]
    suffix = model.get("end_of_word_suffix") or ""
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [(vocab[a], vocab[b], vocab[a.removesuffix(suffix) + b if suffix else a + b]) for a, b in pairs]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    labels = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for t, i in (vocab | special).items():
        labels[i] = t.encode()
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    out = CompiledBpe(MergeAutomaton(merged), labels, special=special, nfc="NFC" in kinds, lowercase="Lowercase" in kinds)
    out.pattern = re.sub(r"\\p\{[LN]\}|\\s", lambda m: {r"\p{L}": LETTER, r"\p{N}": NUMBER}.get(m[0], r"\p{White_Space}"), split)
    byte = {c: b for b, c in enumerate(_byte_alphabet())}
    for t, i in vocab.items():
        if i in out.automaton.dead:
            continue
        ends = bool(suffix) and t.endswith(suffix)
        body = bytes(byte[c] for c in (t.removesuffix(suffix) if ends else t))
        (out.final if ends or not suffix else out.inner)[body] = i
    if not suffix:
        out.inner = out.final
    return out


class BpeTokenizer:
    """Encoder and decoder by a compiled vocabulary; what it remembers is bounded."""

    def __init__(self, compiled: CompiledBpe, cache_limit: int = 160_000):
        self.automaton, self.labels, self.special = compiled.automaton, compiled.labels, compiled.special
        self.inner, self.final = compiled.inner, compiled.final
        self.longest = max(map(len, [*self.inner, *self.final]), default=0)
        self.nfc, self.lowercase = compiled.nfc, compiled.lowercase
        self.pattern = regex.compile(compiled.pattern, regex.V1)
        self.takes_letters = f"|[{LETTER}]+|" in compiled.pattern
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        self.cache_limit = cache_limit
        # Two generations: when the younger is full it becomes the older, and what is met again moves back.
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, bytes]] = {}

    def encode_word(self, word: bytes) -> list[int]:
        """The token ids of one pre-split word.

        One state is reached at each place: the token that ends there and follows the state at its own start.
        """
        whole = self.final.get(word)
        if whole is not None:
            return [whole]
        inner, final, follows, get, longest = self.inner.get, self.final.get, self.automaton.follows, self.automaton.table.get, self.longest
        n = len(word)
        states, starts = [-1] * (n + 1), [-1] * (n + 1)
        asked = [n]
        while asked:  # the last place first: few of the others are ever asked for
            j = asked[-1]
            token = final if j == n else inner
            i = starts[j] if starts[j] >= 0 else j - longest if j > longest else 0
            while i < j:
                t = token(word[i:j])
                if t is not None:
                    if not i:
                        break
                    last = states[i]
                    if last < 0:
                        starts[j] = i  # goes on from here once the state at i is known
                        asked.append(i)
                        break
                    found = get((last << 32) + t)
                    if follows(last, t) if found is None else found:
                        break
                i += 1
            else:
                raise ValueError(f"the vocabulary lacks a symbol of {word!r}")
            if asked[-1] == j:
                states[j], starts[j] = t, i
                asked.pop()
        out, j = [], n
        while j:
            out.append(states[j])
            j = starts[j]
        return out[::-1]

    def _plain(self, text: str, out: list[int]) -> None:
        if not text.isascii():
            if self.nfc:
                text = normalised(text)
            if self.lowercase:  # character by character: no rule for a sigma at a word's end
                text = text.translate(_SMALL).lower()
        elif self.lowercase:
            text = text.lower()
        for word in self.pattern.findall(text):
            out.extend(self.encode_word(word.encode()))

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; strings of special tokens become their ids."""
        out: list[int] = []
        if not any(t in text for t in self.special):
            if text:
                self._plain(text, out)
            return out
        for part in self.special_pattern.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                self._plain(part, out)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs, joined by one space; special tokens are kept."""
        labels = self.labels
        found = [labels[i] if 0 <= i < len(labels) else b"" for i in ids]
        if not all(found):
            raise KeyError("an id outside the vocabulary")
        return b" ".join(found).decode()

    def _emitted(self, ids: list[int]) -> tuple[bytes, bytes]:
        return array("i", ids).tobytes(), b" ".join([self.labels[i] for i in ids])

    def _remember(self, chunk: bytes, found: tuple[bytes, bytes]) -> tuple[bytes, bytes]:
        if len(chunk) <= 48:
            if len(self.chunks) >= self.cache_limit:
                self.chunks, self.older = {}, self.chunks
            self.chunks[chunk] = found
        return found

    def _word(self, word: bytes) -> tuple[bytes, bytes]:
        found = self.chunks.get(word)
        return found or self._remember(word, self.older.get(word) or self._emitted(self.encode_word(word)))

    def chunk(self, chunk: bytes) -> tuple[bytes, bytes]:
        """Of a piece without white space: its ids as int32 bytes and its decoded text."""
        found = self.older.get(chunk)
        if found is None:
            if self.takes_letters and chunk[:-1].isalpha():  # a run of ASCII letters, which the pattern takes whole
                small = chunk.lower() if self.lowercase else chunk
                if chunk[-1] in b".,;:!?":
                    (a, x), (b, y) = self._word(small[:-1]), self._word(small[-1:])
                    found = (a + b, x + b" " + y)
                elif chunk[-1:].isalpha():
                    if small == chunk:
                        return self._word(chunk)
                    found = self._word(small)
            if found is None:
                found = self._emitted(self.encode(chunk.decode("utf-8", "replace")))
        return self._remember(chunk, found)

    def encode_bytes(self, text: bytes) -> tuple[bytes, bytes]:
        """A whole text's ids as int32 bytes, and what they decode to.

        No word crosses ASCII white space and neither normalisation nor lower-casing looks across it, so
        a text is the sum of its chunks, most of which have been met before.
        """
        known, chunk = self.chunks, self.chunk
        found = [known.get(c) or chunk(c) for c in text.split()]
        return b"".join([f[0] for f in found]), b" ".join([f[1] for f in found if f[1]])


_BUILT: dict[str, BpeTokenizer] = {}


def _sent(spark, path: str):
    """The vocabulary of a file, compiled here and broadcast, with a name by which workers tell it from others."""
    with open(path, "rb") as f:
        source = f.read()
    return spark.sparkContext.broadcast(pickle.dumps(compile_bpe(source), 5)), hashlib.sha256(source).hexdigest()


def _built(sent) -> BpeTokenizer:
    shared, name = sent
    kept_by("bpe", _BUILT)
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = BpeTokenizer(pickle.loads(shared.value))
    return _BUILT[name]


def bpe_encode(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", with_decoded: bool = True) -> DataFrame:
    """Encodes every whole text: ``doc_id, n_tokens long, ids array<int>[, decoded string]``.

    One row for each input row, in no shuffle. A null or empty text, or one of white space only, gives no
    tokens and an empty decoded text. A null ``doc_id`` and repeated rows pass as they are; other columns
    are left out, whatever their names. The vocabulary file is compiled once on the driver and
    broadcast (a fixed 2 MB); what workers remember beside it is bounded.
    """
    sent = _sent(docs.sparkSession, tokenizer_path)
    out_schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, ids array<int>" + ", decoded string" * with_decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _built(sent)
        for whole in batches:
            for batch in slices(whole, "__text"):
                ids, decoded = [], []
                for t in values(batch.column(1)):
                    a, b = tokenizer.encode_bytes(t)
                    ids.append(a)
                    decoded.append(b)
                counts = np.array([len(a) // 4 for a in ids], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), type=pa.int32())
                columns = [batch.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), flat)]
                if with_decoded:
                    columns.append(pa.array(decoded, type=pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    return docs.select(F.col(doc_id).alias("__id"), text_bytes(docs, text).alias("__text")).mapInArrow(run, out_schema)


def bpe_decode(encoded: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Decodes ids: ``doc_id, decoded string``, the arcs' labels joined by one space.

    Null or empty ids give an empty text; an id outside the vocabulary raises KeyError.
    """
    sent = _sent(encoded.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _built(sent)
        for batch in batches:
            decoded = [tokenizer.decode(i or ()) for i in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, type=pa.string())], names=["doc_id", "decoded"])

    kind = encoded.schema[doc_id].dataType.simpleString()
    return encoded.select(F.col(doc_id).alias("__id"), F.col(ids).alias("__ids")).mapInArrow(run, f"doc_id {kind}, decoded string")
