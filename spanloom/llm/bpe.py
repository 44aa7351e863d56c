"""BPE encoding and decoding by streaming transducers of constant memory.

*Encoding.*  A boundary between two symbols is open until the merges that could still swallow it are
decided, and that depends on a bounded number of symbols to its right.  Let the merge of rank ``j``
join ``u_j`` and ``v_j``.  If two continuations of a text treat a boundary differently, then the token
to its right differs at the time of some merge ``j``: either ``v_j`` reaches beyond what has been
read, or an earlier merge ``i < j`` whose ``u_i`` begins ``v_j`` differs at its own boundary,
``|u_i|`` symbols further right.  So ::

    reach(j) = max(|v_j|, max of |u_i| + reach(i) over i < j with u_i on the left spine of v_j)

and a boundary with ``max reach`` symbols read behind it is final (``sufficient_lookahead``).  The
transducer keeps no more symbols than that, one token and a chunk, and emits what lies before.

*Decoding.*  Bytes of tokens are gathered for a chunk of ids at a time and pass through an incremental
UTF-8 state machine, which carries the unfinished character from chunk to chunk.
"""

import codecs
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.stage import parts

CHUNK = 1 << 16  # characters, or ids, that pass through a transducer at once
CACHED = 1 << 18  # words remembered by a task in each of two generations
NEVER = 1 << 62
_LOADED: dict = {}  # what a worker reads or derives once
TOGETHER = 4 << 20  # bytes of texts handled before rows are passed on


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for the 256 bytes: printable ones themselves, the others from 256 on."""

    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Symbols to the right of a boundary that decide it, for merges ``(left, right, product)`` by rank."""

    made: dict[int, int] = {}  # product -> its left part
    reach: dict[int, int] = {}  # left part -> the longest reach of a merge that begins with it
    most = 0
    for left, right, product in merges:
        for part in (left, right):
            if length[part] > 1 and part not in made:
                raise ValueError("a merge uses a token that no earlier merge makes")
        if product in made:
            raise ValueError("two merges make the same token")
        here, spine = length[right], right
        while True:
            if spine in reach:
                here = max(here, length[spine] + reach[spine])
            if spine not in made:
                break
            spine = made[spine]
        made[product] = left
        reach[left] = max(reach.get(left, 0), here)
        most = max(most, here)
    return most


def composing() -> set[str]:
    """Characters that can join the character before them under canonical composition."""

    if "composing" in _LOADED:
        return _LOADED["composing"]
    second = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(0x110000):
        pair = unicodedata.decomposition(chr(c)).split()
        if len(pair) == 2 and not pair[0].startswith("<"):
            second.add(chr(int(pair[1], 16)))
    _LOADED["composing"] = second
    return second


# Letters and digits that the library behind the vocabulary files does not know yet.
NEWER = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF
10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
# Capitals that the library lowers and older interpreters do not.
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


NEWER_SET = "[" + "".join("-".join(f"\\U{int(end, 16):08x}" for end in part.split("-")) for part in NEWER.split()) + "]"


def letters_and_digits(pattern: str):
    """``pattern`` with its letters and digits narrowed to those the library knows."""

    new = NEWER_SET
    for own, narrow in ((r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{new}]"), (r"[\p{L}]", rf"[\p{{L}}--{new}]"), (r"[\p{N}]", rf"[\p{{N}}--{new}]")):
        pattern = pattern.replace(own, narrow)
    return regex.compile(pattern, regex.V1)


class Vocabulary:
    """Tokens, merges and rules of one tokenizer file: BPE over bytes whose words end in a suffix."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value of the file format

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or split != self.PATTERN or kinds != ["NFC", "Replace", "Lowercase"] or not plain or spec["decoder"]:
            raise ValueError("not a lower-casing word BPE file")
        self.suffix = model["end_of_word_suffix"]
        ids = model["vocab"]
        self.alphabet = byte_alphabet()
        self.inner = [0] * 256  # the symbol of a byte inside a word, and at its end
        self.final = [0] * 256
        length = {}
        for char, byte in self.alphabet.items():
            self.inner[byte], self.final[byte] = ids[char], ids[char + self.suffix]
            length[ids[char]] = length[ids[char + self.suffix]] = 1
        merges = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            product = ids[left + right]
            merges.append((ids[left], ids[right], product))
            length[product] = length[ids[left]] + length[ids[right]]
        self.lookahead = sufficient_lookahead(merges, length)
        self.length = length
        self.longest = max(length.values())
        self.ranks = {(left, right): rank << 32 | product for rank, (left, right, product) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with rules of their own")
        self.tokens = {i: token for token, i in [*ids.items(), *self.special.items()]}

    def merge(self, symbols: list[int]) -> list[int]:
        """Tokens of a sequence of symbols: the merge of lowest rank first, the leftmost of equal ones."""

        n = len(symbols)
        find = self.ranks.get
        if n <= 48:  # the usual word
            token = list(symbols)
            pairs = [find(pair, NEVER) for pair in zip(token, token[1:], strict=False)]
            while pairs and (best := min(pairs)) != NEVER:
                i = pairs.index(best)
                token[i : i + 2] = [best & 0xFFFFFFFF]
                del pairs[i]
                if i:
                    pairs[i - 1] = find((token[i - 1], token[i]), NEVER)
                if i < len(pairs):
                    pairs[i] = find((token[i], token[i + 1]), NEVER)
            return token
        token, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (found := find((symbols[i], symbols[i + 1]))) is not None]
        heapify(heap)
        while heap:
            best, i, left, right = heappop(heap)
            j = after[i]
            if token[i] != left or j >= n or token[j] != right:
                continue
            product = best & 0xFFFFFFFF
            token[i], token[j] = product, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (found := find((product, token[after[i]]))) is not None:
                    heappush(heap, (found, i, product, token[after[i]]))
            if before[i] >= 0 and (found := find((token[before[i]], product))) is not None:
                heappush(heap, (found, before[i], token[before[i]], product))
        return [t for t in token if t >= 0]


class WordEncoder:
    """One word, byte by byte: ``feed`` returns the tokens that no further byte can change."""

    def __init__(self, vocabulary: Vocabulary, chunk: int = 512):
        self.v = vocabulary
        self.chunk = chunk
        self.most = vocabulary.lookahead + vocabulary.longest
        self.open: list[int] = []  # symbols behind the last token emitted
        self.last: int | None = None  # a byte held back

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        inner = self.v.inner
        if self.last is not None:
            data = bytes((self.last,)) + data
        if data:
            self.last = data[-1]  # it may prove to be the last one of the word
        for at in range(0, len(data) - 1, self.chunk):
            self.open += [inner[byte] for byte in data[at : min(at + self.chunk, len(data) - 1)]]
            if len(self.open) > self.most:
                out += self.stable()
        return out

    def stable(self) -> list[int]:
        """Tokens that end at least the lookahead before the last symbol read."""

        known, done, out = len(self.open) - self.v.lookahead, 0, []
        for token in self.v.merge(self.open):
            if done + self.v.length[token] > known:
                break
            done += self.v.length[token]
            out.append(token)
        self.open = self.open[done:]
        return out

    def finish(self) -> list[int]:
        if self.last is None:
            return []
        out = self.v.merge([*self.open, self.v.final[self.last]])
        self.open, self.last = [], None
        return out


class TextEncoder:
    """Token ids of texts as packed little-endian 32-bit numbers, a chunk of characters at a time."""

    def __init__(self, vocabulary: Vocabulary, chunk: int = CHUNK):
        self.v, self.chunk = vocabulary, chunk
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.plain = regex.compile(vocabulary.PATTERN).findall
        self.new, self.high = regex.compile(NEWER_SET), re.compile("[\u0558-\U0010ffff]")
        self.capital = re.compile("[" + "".join(map(chr, CAPITALS)) + "]")
        self.exact = letters_and_digits(vocabulary.PATTERN).findall  # slower
        self.runs = {"L": letters_and_digits(r"[\p{L}]+"), "O": letters_and_digits(r"[^\s\p{L}\p{N}]+")}
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None

    def word(self, word: str) -> bytes:
        """Ids of a word that is not among the recent ones; rare words are forgotten first."""

        packed = self.older.get(word)
        if packed is None:
            encoder = WordEncoder(self.v)
            packed = np.array(encoder.feed(word.encode()) + encoder.finish(), "<u4").tobytes()
        if len(word) <= 64:
            if len(self.words) >= CACHED:
                self.older, self.words = self.words, {}
            self.words[word] = packed
        return packed

    def cuts(self, text: str) -> Iterator[str]:
        """Chunks of a text, cut where neither normalization, a special token nor a contraction spans."""

        start, longest = 0, max(map(len, self.v.special), default=1)
        while len(text) - start > self.chunk:
            at = start + self.chunk
            while at < len(text):
                c = text[at]
                if (
                    (c < "\x80" or (not unicodedata.combining(c) and c not in composing()))
                    and (c == "'" or "'" not in text[max(at - 2, 0) : at])
                    and not (self.special and any(m.start() + max(at - longest, 0) < at < m.end() + max(at - longest, 0) for m in self.special.finditer(text[max(at - longest, 0) : at + longest])))
                ):
                    break
                at += 1
            yield text[start:at]
            start = at
        yield text[start:]

    def segments(self, chunk: str) -> Iterator[str | int]:
        """Ordinary text, and the ids of special tokens between."""

        at = 0
        for m in self.special.finditer(chunk) if self.special and "<" in chunk else ():
            yield chunk[at : m.start()]
            yield self.v.special[m.group()]
            at = m.end()
        yield chunk[at:]

    def find(self, text: str) -> list[str]:
        return (self.exact if not text.isascii() and self.high.search(text) and self.new.search(text) else self.plain)(text)

    def normal(self, text: str) -> str:
        # one character at a time has no final form of sigma; white space only separates
        plain = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return plain.translate(CAPITALS) if not plain.isascii() and self.capital.search(plain) else plain

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids of one text; a word that a chunk cuts goes on in the next one."""

        known, word = self.words.get, self.word
        going: tuple[str, WordEncoder] | None = None

        def close() -> bytes:
            nonlocal going
            ids, going = going[1].finish(), None
            return np.array(ids, "<u4").tobytes()

        more = len(text)
        for chunk in self.cuts(text):
            more -= len(chunk)
            for segment in self.segments(chunk):
                if isinstance(segment, int):
                    if going:
                        yield close()
                    yield np.array([segment], "<u4").tobytes()
                    continue
                plain = self.normal(segment)
                if going and plain:
                    run = self.runs[going[0]].match(plain)
                    if run:
                        yield np.array(going[1].feed(run.group().encode()), "<u4").tobytes()
                        plain = plain[run.end() :]
                    if plain:
                        yield close()
                found = self.find(plain)
                if more and found and plain.endswith(found[-1]) and segment and chunk.endswith(segment):
                    last = found[-1]
                    kind = next((k for k, run in self.runs.items() if run.fullmatch(last)), None)
                    if kind and last not in ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"):
                        yield b"".join([known(w) or word(w) for w in found[:-1]])
                        going = (kind, WordEncoder(self.v))
                        yield np.array(going[1].feed(last.encode()), "<u4").tobytes()
                        continue
                yield b"".join([known(w) or word(w) for w in found])
        if going:
            yield close()


class TokenDecoder:
    """Text of token ids; ``feed`` returns the characters that are complete.

    ``spaced`` writes the tokens themselves with a space between, as a file without a decoder asks for;
    otherwise their bytes are joined, with a space for the suffix that ends a word.
    """

    def __init__(self, vocabulary: Vocabulary, spaced: bool = True):
        size = max(vocabulary.tokens) + 1
        table = [b""] * size
        for i, token in vocabulary.tokens.items():
            if spaced:
                table[i] = b" " + token.encode()
            elif i in vocabulary.special.values():
                table[i] = token.encode()
            else:
                end = vocabulary.suffix and token.endswith(vocabulary.suffix)
                body = token[: -len(vocabulary.suffix)] if end else token
                table[i] = bytes(vocabulary.alphabet[c] for c in body) + (b" " if end else b"")
        self.lengths = np.array([len(b) for b in table])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.spaced = spaced
        self.reset()

    def reset(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def feed(self, ids: np.ndarray) -> str:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        data = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - n), n)].tobytes()
        if self.spaced and self.first and len(ids):
            data = data[1:]
            self.first = False
        return self.machine.decode(data)

    def finish(self) -> str:
        rest = self.machine.decode(b"", True)
        self.reset()
        return rest

    def decode(self, packed: bytes, chunk: int = CHUNK) -> str:
        ids = np.frombuffer(packed, "<u4")
        return "".join([*(self.feed(ids[i : i + chunk]) for i in range(0, len(ids), chunk)), self.finish()])


def load(path: str) -> Vocabulary:
    """A worker reads a tokenizer file once."""

    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_tokens, ids`` of every row: the token ids packed as little-endian 32-bit numbers.

    Null and empty texts have no tokens; strings of special tokens in a text become those tokens, no others
    are added.  Each row is encoded once, repeated rows and null identifiers of any type too; other columns
    are left out whatever their names.  An empty table gives no rows.  ``tokenizer`` is the path of the
    vocabulary file, which every executor must have.  Nothing is shuffled.
    """

    rows = docs.select(F.col(id_column), F.col(text).alias("text_"))
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_tokens long, ids binary"

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(load(tokenizer))
        for batch in batches:
            texts = batch.column(1)
            for a, b in parts(texts, TOGETHER):
                packed = [b"".join(encoder.encode(t)) if t else b"" for t in texts[a:b].to_pylist()]
                n = pa.array([len(p) // 4 for p in packed], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], n, pa.array(packed, pa.binary())], [id_column, "n_tokens", "ids"])

    return rows.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, tokenizer: str, spaced: bool = True, ids: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with ``decoded``, the text of the packed ``ids``, in their place.

    Null ids give an empty text.  A column named ``decoded`` is replaced.  See ``TokenDecoder`` for ``spaced``.
    """

    rows = encoded.drop("decoded") if ids != "decoded" else encoded
    names = [c for c in rows.columns if c != ids]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), "decoded string"])

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = TokenDecoder(load(tokenizer), spaced)
        for batch in batches:
            packed = batch.column(batch.schema.get_field_index(ids))
            for a, b in parts(packed, 2 * TOGETHER):
                texts = pa.array([decoder.decode(p.as_py() or b"") for p in packed[a:b]], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in names), texts], [*names, "decoded"])

    return rows.select(*names, ids).mapInArrow(decode, schema)
