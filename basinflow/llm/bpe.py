"""Byte-level BPE by prefix dynamic programming: every byte prefix has one valid last token."""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import blank_if_null, keeps, make_room, small_batches


class Vocabulary:
    """Ranks of byte strings, and which two tokens may stand side by side.

    A token's canonical split is the pair whose merge makes it when BPE runs on its bytes; tokens
    that BPE never makes have none and serve only as whole pieces.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.longest = max(map(len, ranks), default=1)
        self.split: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        for b in sorted(ranks, key=len):
            self.split[ranks[b]] = self._canonical(b)
        self.made = {i for i, s in self.split.items() if s is not None or len(self.bytes_of[i]) == 1}
        self.id_of = {self.bytes_of[i]: i for i in self.made}
        self.finder = ahocorasick.Automaton()
        for i in self.made:
            self.finder.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.finder.make_automaton()

    def _canonical(self, b: bytes) -> tuple[int, int] | None:
        if len(b) == 1:
            return None
        parts = merge(b, self.ranks, self.ranks[b])
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def beside(self, left: int, right: int) -> bool:
        """Whether BPE on the bytes of both leaves exactly these two tokens; remembered."""
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        stands = self.pairs[left << 24 | right] = self._stands(left, right)
        return stands

    def last_token(self, data: bytes, end: int, last: dict[int, int]) -> int:
        """The last token of a short prefix, longest candidate first; `last` gets it and those it needed.

        Only prefixes that a candidate leaves are worked out. The depth is the length at most."""
        made, known = self.id_of.get, self.pairs.get
        for start in range(end):
            token = made(data[start:end])
            if token is None:
                continue
            if start:
                left = last.get(start)
                if left is None:
                    left = self.last_token(data, start, last)
                stands = known(left << 24 | token)
                if not (self.beside(left, token) if stands is None else stands):
                    continue
            last[end] = token
            return token
        raise ValueError("the vocabulary lacks a single byte")

    def short(self, data: bytes) -> list[int]:
        """The ids of a piece of few bytes, as those of Piece."""
        last, out, end = {}, [], len(data)
        if end:
            self.last_token(data, end, last)
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def _stands(self, left: int, right: int) -> bool:
        """Undoes the merges of both sides, latest first: the pair falls if at some moment the two
        tokens at the border could have merged before either side's next merge."""
        ranks, of, split = self.ranks, self.bytes_of, self.split
        bound = len(ranks) + 256
        while True:
            joint = ranks.get(of[left] + of[right])
            if joint is not None and joint in self.made and split[joint] == (left, right) and joint < bound:
                return False
            # The side whose token was made last was, just before, its two parts. Of equal ranks
            # (the same token on both sides) the left one was made first.
            # A joint merge of the right token's own rank would come first, as it lies further left.
            a, b = split[left], split[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]


def merge(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Plain BPE: merges the leftmost pair of least rank while that is under `below`."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Piece:
    """The bytes of one piece with the last token of each prefix; may grow and be edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Only the new prefixes are worked out: earlier ones don't depend on what follows.

        An automaton finds the tokens that end at each byte; of them one stands beside the last
        token of the prefix before it.
        """
        v, start = self.vocabulary, len(self.data)
        data = self.data = self.data + more
        last, known, beside = self.last, v.pairs.get, v.beside
        base = max(0, start - v.longest)
        last += [-1] * len(more)
        for at, (token, n) in v.finder.iter(data[base:].decode("latin-1")):
            end = base + at + 1
            if end <= start or last[end] >= 0:
                continue
            if n < end:
                left = last[end - n]
                stands = known(left << 24 | token)
                if not (beside(left, token) if stands is None else stands):
                    continue
            last[end] = token
        if more and min(last[start + 1 :]) < 0:
            raise ValueError("the vocabulary lacks a single byte")

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Works out prefixes from the edit on, and stops once they agree with the old ones.

        When the last tokens of `longest` prefixes in a row have stayed the same, all later ones
        stay the same too, as each depends on no others before it.
        """
        old, tail, v = self.last, self.data[stop:], self.vocabulary
        shift = len(new) - (stop - start)
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(new)
        same, at = 0, 0
        while at < len(tail) and same < v.longest:
            self.append(tail[at : at + 1])
            at += 1
            same = same + 1 if self.last[-1] == old[stop + at] else 0
        self.data += tail[at:]
        self.last += old[stop + at + 1 :]
        assert len(self.last) == len(self.data) + 1 and shift == len(self.data) - len(old) + 1

    def ids(self) -> list[int]:
        if self.data in self.vocabulary.ranks:
            return [self.vocabulary.ranks[self.data]]
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Recent:
    """A bounded cache of two generations: when the young one is full it becomes the old one, and
    what is asked for again moves back, so that frequent keys outlive rare ones."""

    def __init__(self, bound: int):
        self.half, self.young, self.old = bound // 2, {}, {}

    def get(self, key, default=None):
        found = self.young.get(key, self)
        if found is self:
            found = self.old.get(key, self)
            if found is self:
                return default
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Encoder:
    """Text to ids and back. Caches are bounded by entries and by the length of what they keep."""

    CHUNKS, PIECES, LONG, SHORT = 600_000, 200_000, 64, 32

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.blank = regex.compile(r"\s").match
        self.chunks, self.pieces = Recent(self.CHUNKS), Recent(self.PIECES)

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.pieces.get(text)
        if ids is None:
            data = text.encode()
            whole = self.vocabulary.ranks.get(data)
            ids = (whole,) if whole is not None else tuple(self.vocabulary.short(data) if len(data) <= self.SHORT else Piece(self.vocabulary, data).ids())
            if len(text) <= self.LONG:
                self.pieces.put(text, ids)
        return ids

    def _run(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.piece, self.pattern.findall(text))))

    def _cut(self, x: str) -> tuple[int, ...] | None:
        ids = self.chunks.get(x, 0)
        if ids == 0:
            # An empty cut or one that begins with white space isn't one; the whole text is then matched at once.
            ids = None if not x or self.blank(x) else self._run(" " + x)
            if len(x) <= self.LONG:
                self.chunks.put(x, ids)
        return ids

    def encode(self, text: str) -> list[int]:
        """A boundary between matches always lies before a blank that something other than white
        space follows, so the text is cut there first and equal cuts are encoded once."""
        if not text:
            return []
        first, *rest = text.split(" ")
        found, young = [self._run(first)], self.chunks.young
        for x in rest:
            ids = young.get(x, 0)
            if ids == 0:
                ids = self._cut(x)
                young = self.chunks.young
            if ids is None:
                return list(self._run(text))
            found.append(ids)
        return list(chain.from_iterable(found))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


class Document:
    """A text under edit: matches are redone only near the edit, and their pieces re-encoded."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.cuts = [m.span() for m in encoder.pattern.finditer(text)]
        self.tokens = [encoder.piece(text[a:b]) for a, b in self.cuts]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> None:
        """A match depends on its own characters and few after it: matches that end well before
        the edit stay, and after it the old ones hold again from the first common boundary on."""
        text = self.text[:start] + new + self.text[stop:]
        shift = len(new) - (stop - start)
        keep = 0
        while keep < len(self.cuts) and self.cuts[keep][1] + 3 <= start:
            keep += 1
        later = {a: i for i, (a, _) in enumerate(self.cuts) if a >= stop}
        cuts, at, rest = self.cuts[:keep], self.cuts[keep - 1][1] if keep else 0, len(self.cuts)
        while at < len(text):
            if at >= start + len(new) and at - shift in later:
                rest = later[at - shift]
                break
            m = self.encoder.pattern.match(text, at)
            cuts.append(m.span())
            at = m.end()
        tokens = self.tokens[:keep] + [self.encoder.piece(text[a:b]) for a, b in cuts[keep:]] + self.tokens[rest:]
        self.text, self.cuts, self.tokens = text, cuts + [(a + shift, b + shift) for a, b in self.cuts[rest:]], tokens

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.tokens))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of base64 tokens and their ids. The file's size bounds what is sent out."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _worker_encoder(packed: bytes, pattern: str) -> Encoder:
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in packed.split(b"\n") if x)}
    return Encoder(Vocabulary(ranks), pattern)


keeps("bpe", _worker_encoder.cache_clear)


def pack_ranks(ranks: dict[bytes, int]) -> bytes:
    return b"\n".join(base64.b64encode(b) + b" %d" % i for b, i in ranks.items())


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = True) -> DataFrame:
    """Encodes every whole text, decodes the ids again and gives the digests of both.

    docs: doc_id, text; more columns are ignored. Returns doc_id, n_tokens, ids_sha256 (of the
    decimal ids joined by commas), decoded_sha256 and, with with_ids, ids.

    Null and empty texts have no ids and the digests of nothing. Texts of any length are encoded
    in linear time. Repeated rows are treated each by itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    packed = spark.sparkContext.broadcast(pack_ranks(ranks))  # as large as the vocabulary, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("bpe")
        encoder = _worker_encoder(packed.value, pattern)
        for batch in batches:
            out = []
            decimal = encoder.vocabulary.decimal.__getitem__
            gc.disable()  # it would walk the caches again and again; a batch of bounded size leaves no cycles
            try:
                for text in batch.column(1):
                    ids = encoder.encode(text.as_py())
                    out.append((len(ids), hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest(), ids if with_ids else None))
            finally:
                gc.enable()
            n, ids_sha, text_sha, all_ids = zip(*out) if out else ((), (), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select("doc_id", blank_if_null("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)
