"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

Encoding.  A text is read in parts that end with white space, which separates words and belongs to none; a part is
normalised and cut into words, and each word's bytes run through ``Transducer``, which may be fed in pieces of any size.
It holds a window of symbols; tokens that end at least ``lookahead`` symbols before the window's end can no longer change
and are emitted, so memory stays constant however long a text or a word is.  Tokens of recent short words are kept.

Sufficient lookahead.  Let a string be cut off at some place, and the rest arrive later.  Merges happen in the order of
the merge list.  Up to some merge both processes (with and without the rest) agree left of a boundary.  The boundary only
moves left when a merge (x, y) takes a y that begins at the boundary in one of the processes and not in the other; then
it moves over x, and at the new boundary begins xy in the one process and x in the other, before later merges only.  One
pass over the merge list in its order keeps, for each token, the furthest that the boundary can have moved when that
token begins there.  The largest value plus the longest token bounds how far what is still to come can reach back.

Decoding.  Ids become the bytes of their pieces, and ``ByteText`` is a state machine from bytes to text that holds at most
an incomplete character between calls.  ``encode_documents`` digests ids and decoded text part by part.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
WINDOW = 512
#: Characters of a text that are read at a time.
PART = 1 << 16
CACHED_WORDS = 300_000
CACHED_LENGTH = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is a visible Latin-1 one, else from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length=len) -> int:
    """A number of symbols after which nothing still to come changes a token; see the module's text."""
    reach: dict[str, int] = {}
    longest = 1
    for x, y in merges:
        whole, moved = x + y, reach.get(y, 0) + length(x)
        # x continues a token that begins at the boundary; y begins at the boundary
        reach[whole] = max(reach.get(whole, 0), reach.get(x, 0), moved)
        reach[x] = max(reach.get(x, 0), moved)
        longest = max(longest, length(whole))
    return max(reach.values(), default=0) + longest


def apply_merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The tokens of a sequence of symbols: of the merges that apply the first of the list is done at its leftmost place, again and again."""
    word, get, never = list(symbols), ranks.get, len(ranks)
    found = [get(p, never) for p in zip(word, word[1:], strict=False)]
    while found:
        best = min(found)
        if best == never:
            break
        i = found.index(best)
        word[i : i + 2] = [word[i] + word[i + 1]]
        del found[i]
        if i:
            found[i - 1] = get((word[i - 1], word[i]), never)
        if i < len(found):
            found[i] = get((word[i], word[i + 1]), never)
    return word


class _Cache(dict):
    """Ids of recent words: two generations, the older one goes when the younger is full."""

    def __init__(self, encode, size: int, longest: int):
        super().__init__()
        self.encode, self.size, self.longest = encode, size, longest
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= self.longest:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Transducer:
    """Symbols in, stable tokens out.  At most ``window`` symbols plus the fed piece are held."""

    def __init__(self, ranks: dict[tuple[str, str], int], lookahead: int, window: int = WINDOW, length=len):
        self.ranks, self.lookahead, self.length = ranks, lookahead, length
        self.window = max(window, 2 * lookahead + 2)
        self.held: list[str] = []

    def feed(self, symbols: Iterable[str]) -> Iterator[str]:
        for s in symbols:
            self.held.append(s)
            if len(self.held) >= self.window:
                yield from self._emit()

    def _emit(self) -> Iterator[str]:
        tokens, used = apply_merges(self.held, self.ranks), 0
        for t in tokens:
            n = self.length(t)
            if used + n > len(self.held) - self.lookahead:
                break
            used += n
            yield t
        # what was emitted is final, but it decides how the rest is read: tokens behind it start at its end
        self.held = self.held[used:]

    def finish(self) -> list[str]:
        out, self.held = apply_merges(self.held, self.ranks), []
        return out


class ByteText:
    """Bytes in, text out; an incomplete character waits for its bytes, an invalid one becomes U+FFFD."""

    def __init__(self):
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self._machine.decode(data)

    def finish(self) -> str:
        return self._machine.decode(b"", True)


class WordBPE:
    """Encoder and decoder for a vocabulary file of lower-cased word BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.pieces = [""] * (max(max(self.vocab.values()), *(t["id"] for t in spec["added_tokens"])) + 1)
        for piece, i in self.vocab.items():
            self.pieces[i] = piece
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for piece, i in self.special.items():
            self.pieces[i] = piece
        self.piece_bytes = [p.encode() for p in self.pieces]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: r for r, m in enumerate(merges)}
        suffix = len(self.suffix)
        self.length = lambda t: len(t) - suffix if suffix and t.endswith(self.suffix) and len(t) > suffix else len(t)
        if len({x + y for x, y in merges}) < len(merges):
            raise ValueError("two merges make the same token: the list's order doesn't bound the lookahead")
        self.lookahead = sufficient_lookahead(merges, self.length)
        self.symbols = byte_symbols()
        self.bytes = {c: b for b, c in enumerate(self.symbols)}
        patterns = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(patterns[0])
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.cache = _Cache(lambda word: tuple(map(self.vocab.__getitem__, self._tokens(word))), CACHED_WORDS // 2, CACHED_LENGTH)

    def _tokens(self, word: str) -> Iterator[str]:
        data = word.encode()
        machine = Transducer(self.ranks, self.lookahead, length=self.length)
        yield from machine.feed(self.symbols[b] for b in data[:-1])
        yield from machine.feed([self.symbols[data[-1]] + self.suffix])
        yield from machine.finish()

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the strings of special tokens are read as these."""
        if self.specials is None or "<|" not in text:
            return self._plain(text)
        out: list[int] = []
        for part in self.specials.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character is lowered for itself
        words = self.words.findall(text.lower())
        return list(chain.from_iterable(map(self.cache.__getitem__, words)))

    def decode(self, ids: Iterable[int]) -> str:
        """The pieces joined by a space, special tokens included, as a file without a decoder says."""
        machine = Decoder(self)
        return machine.feed(ids) + machine.finish()

    def to_text(self, ids: Iterable[int]) -> Iterator[str]:
        """Readable text, bit by bit: bytes of the pieces through the state machine, a space for each end of a word."""
        machine = ByteText()
        for i in ids:
            piece = self.pieces[i]
            if piece in self.special:
                yield machine.feed(piece.encode())
                continue
            end = bool(self.suffix) and piece.endswith(self.suffix)
            data = bytes(self.bytes[c] for c in (piece[: -len(self.suffix)] if end else piece))
            yield machine.feed(data + b" " * end)
        yield machine.finish()


class Decoder:
    """Ids in, bit by bit, the text of ``WordBPE.decode`` out: the bytes of pieces and of the spaces between them run through ``ByteText``."""

    def __init__(self, model: WordBPE):
        self.data = model.piece_bytes
        self.machine, self.begun = ByteText(), False

    def feed(self, ids: Iterable[int]) -> str:
        data = b" ".join(map(self.data.__getitem__, ids))
        if not data:
            return ""
        lead, self.begun = b" " * self.begun, True
        return self.machine.feed(lead + data)

    def finish(self) -> str:
        return self.machine.finish()


def parts(text: str, size: int = PART) -> Iterator[str]:
    """A text in parts of about ``size`` characters that end with a space or a line's end; a longer word stands whole."""
    start = 0
    while len(text) - start > size:
        end = max(text.rfind(" ", start, start + size), text.rfind("\n", start, start + size)) + 1
        if not end:
            ahead = [k for k in (text.find(" ", start + size), text.find("\n", start + size)) if k >= 0]
            if not ahead:
                break
            end = min(ahead) + 1
        yield text[start:end]
        start = end
    yield text[start:] if start else text


_models: dict[str, WordBPE] = {}


def load(path: str | None = None) -> WordBPE:
    """The model of a vocabulary file, once for each worker process."""
    if path is None:
        import public_tokenizers as public

        path = public.path(TOKENIZER)
    if path not in _models:
        _models[path] = WordBPE(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", ids: bool = True) -> DataFrame:
    """All columns of ``docs`` but its text, plus n_tokens, ids_sha256, decoded_sha256 and (with ``ids``) ids.

    A null text counts as empty: no tokens.  Columns of the input with the names of the results are left out.
    """
    own = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    others = [c for c in docs.columns if c != text and c not in own]
    flat = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema if f.name != text), "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *["ids array<int>"] * ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, digest, decoded, kept = [], [], [], []
                for value in part.column(len(others)).to_pylist():
                    total, found, machine, sums = 0, [], Decoder(model), (hashlib.sha256(), hashlib.sha256())
                    for piece in parts(value or ""):
                        some = model.encode(piece)
                        if some:
                            sums[0].update((" " * (total > 0) + " ".join(map(str, some))).encode())
                            sums[1].update(machine.feed(some).encode())
                        total += len(some)
                        if ids:
                            found += some
                    sums[1].update(machine.finish().encode())
                    n.append(total)
                    digest.append(sums[0].hexdigest())
                    decoded.append(sums[1].hexdigest())
                    kept.append(found)
                columns = [pa.array(n, pa.int64()), pa.array(digest), pa.array(decoded), *[pa.array(kept, pa.list_(pa.int32()))] * ids]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(others))), *columns], names=[*others, *own])

    return flat.mapInArrow(run, schema)


def op3_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, ids=False)
