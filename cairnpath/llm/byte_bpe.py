"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Of the tokens that end at a byte position, exactly one is the last token of the encoding of the bytes up to there: the
one whose predecessor (the last token of the prefix before it) would not merge with it, or with parts of it, first. So a
table with that token for each prefix holds the encodings of all prefixes. It grows by appends without looking back, and
after an edit it is filled anew only until it agrees with the old table again. Time is linear in the bytes.

The vocabulary is a rank file in tiktoken's format, whose single bytes have the ranks 0 to 255. Texts are first cut by the
tokenizer's pattern; each match is encoded separately, and one that is itself a token is that token.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnpath.llm.common import whole

#: Encoded segments kept before the older half goes, and token pairs.
CACHE, PAIRS = 3 << 17, 1 << 20
#: Longer segments aren't kept; characters of text whose segments are encoded together.
KEEP, TOGETHER = 64, 1 << 23
#: A space after white space; without one each space starts a segment that is encoded by itself.
_RUN = regex.compile(r"\s ")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if any(len(t) != 1 for t in tokens[:256]) or not all(tokens):
        raise ValueError("ranks must be dense, with the single bytes first")
    return tokens


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.rank = tokens, {t: i for i, t in enumerate(tokens)}
        self.find = regex.compile(pattern).findall
        self.longest = max(map(len, tokens))
        self.left, self.right = [0] * len(tokens), [0] * len(tokens)
        self._pairs: dict[int, bool] = {}
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        reachable = set(range(256))
        for t in range(256, len(tokens)):
            piece = tokens[t]
            for cut in range(1, len(piece)):
                a, b = self.rank.get(piece[:cut], t), self.rank.get(piece[cut:], t)
                if a < t and b < t and a in reachable and b in reachable and self._stays(a, b, t):
                    self.left[t], self.right[t] = a, b
                    reachable.add(t)
                    break
        # A tree of the tokens from their last byte backwards: node << 8 | byte -> node; a node that is a token has its rank.
        self._step: dict[int, int] = {}
        self._root = spare = 1 << 20
        rank = self.rank
        for t in reachable:
            node, piece = self._root, tokens[t]
            for at in range(len(piece) - 1, -1, -1):
                to = self._step.get(node << 8 | piece[at])
                if to is None:
                    to = rank.get(piece[at:], -1)
                    if to not in reachable:
                        spare += 1
                        to = spare
                    self._step[node << 8 | piece[at]] = to
                node = to

    def _stays(self, a: int, b: int, below: int) -> bool:
        """Whether token b after token a is what merges of ranks under below make of their bytes."""
        rank, tokens = self.rank, self.tokens
        while True:
            if rank.get(tokens[a] + tokens[b], below) < below:
                return False
            if a < 256 and b < 256:
                return True
            # The part that was merged last is taken apart; on a tie the merge further left came first.
            if a > b:
                below, a = a, self.right[a]
            else:
                below, b = b + 1, self.left[b]

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> None:
        """Fills last, the last token of each prefix of data, on to a length or the end; it starts as [-1], for the empty prefix."""
        step, pairs, root = self._step.get, self._pairs, self._root
        for end in range(len(last), (len(data) if upto is None else upto) + 1):
            node, at = root, end
            while True:
                at -= 1
                node = step(node << 8 | data[at])
                if node < root:
                    if not at:
                        break
                    ok = pairs.get(last[at] << 20 | node)
                    if ok is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        ok = pairs[last[at] << 20 | node] = self._stays(last[at], node, root)
                    if ok:
                        break
            last.append(node)

    def refill(self, data: bytes, last: list[int], at: int, removed: int, inserted: bytes) -> tuple[bytes, list[int], int]:
        """data with an edit, its table, and how many entries were filled anew.

        Entries before the edit stay. Behind it an entry rests on as many bytes and entries before it as the longest token
        has, so once so many in a row agree with the old ones, all that follow do.
        """
        new, table, end, shift, same = data[:at] + inserted + data[at + removed :], last[: at + 1], at + len(inserted), len(inserted) - removed, 0
        for place in range(at + 1, len(new) + 1):
            self.extend(new, table, place)
            same = same + 1 if place > end and table[place] == last[place - shift] else 0
            if same >= self.longest:
                return new, table + last[place - shift + 1 :], place - at
        return new, table, len(new) - at

    def walk(self, last: list[int]) -> list[int]:
        """The encoding that a filled table holds."""
        at, out, tokens = len(last) - 1, [], self.tokens
        while at:
            out.append(last[at])
            at -= len(tokens[last[at]])
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one match of the pattern."""
        known = self.rank.get(data)
        if known is not None:
            return [known]
        last = [-1]
        self.extend(data, last)
        return self.walk(last)

    def prepare(self, texts: list[str]) -> None:
        """Encodes the unknown segments of some texts together: in sorted order each goes on from the prefix it shares."""
        young, old = self._young, self._old
        new = {p for text in texts for p in segments(text) if p not in young and len(p) < KEEP}
        for p in [p for p in new if p in old]:
            young[p] = old[p]
            new.discard(p)
        cut = {p: [m.encode() for m in self.find(p)] for p in new}
        done: dict[bytes, bytes] = {}
        before, last = b"", [-1]
        for data in sorted({m for found in cut.values() for m in found}):
            known = self.rank.get(data)
            if known is None:
                same = 0
                for x, y in zip(before, data):  # noqa: B905  the shorter one ends it
                    if x != y:
                        break
                    same += 1
                del last[same + 1 :]
                self.extend(data, last)
                before = data
                done[data] = array("I", self.walk(last)).tobytes()
            else:
                done[data] = array("I", (known,)).tobytes()
        if len(young) + len(cut) > CACHE:
            self._old, self._young = young, {p: young[p] for text in texts for p in segments(text) if p in young}
        self._young.update((p, b"".join([done[m] for m in found])) for p, found in cut.items())

    def packed(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        get = self._young.get
        return b"".join([get(p) or array("I", [t for m in self.find(p) for t in self.piece(m.encode())]).tobytes() for p in segments(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def segments(text: str) -> list[str]:
    """Parts of a text that the pattern never joins: each space after something else than white space starts one."""
    if not text:
        return []
    if _RUN.search(text):
        return [text]
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + p for p in rest]


class Draft:
    """A text that changes, with its encoding: an append or edit encodes the segments that it touches and no others.

    Within one match of the pattern, Codec.refill() goes on from the table before the edit.
    """

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.parts = codec, segments(text)
        self.ids = [codec.encode(p) for p in self.parts]

    def text(self) -> str:
        return "".join(self.parts)

    def encoding(self) -> list[int]:
        return [t for ids in self.ids for t in ids]

    def append(self, more: str) -> None:
        self.replace(sum(map(len, self.parts)), 0, more)

    def replace(self, at: int, removed: int, inserted: str) -> None:
        """Puts inserted in place of the removed characters from position at on."""
        starts = np.cumsum([0, *map(len, self.parts)]).tolist()
        first = max(0, int(np.searchsorted(starts, at, "left")) - 1)
        stop = min(len(self.parts), int(np.searchsorted(starts, at + removed, "right")))
        # What follows the edit may be joined to it by white space, so one segment more on each side.
        first, stop = max(0, first - 1), min(len(self.parts), stop + 1)
        old = "".join(self.parts[first:stop])
        cut = at - starts[first]
        new = segments(old[:cut] + inserted + old[cut + removed :])
        self.parts[first:stop] = new
        self.ids[first:stop] = [self.codec.encode(p) for p in new]


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts exceed TOGETHER characters."""
    for batch in batches:
        ends = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(ends // TOGETHER)) + 1 if len(ends) else []
        for a, b in zip([0, *cuts], [*cuts, len(ends)]):  # noqa: B905
            yield batch.slice(a, b - a)


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(spark: SparkSession, ranks: str, pattern: str) -> Callable[[], Codec]:
    """A function for tasks; it gives the codec, of which a worker process holds one at a time."""
    tokens = read_ranks(ranks)
    key, shared = (hashlib.sha256(b"\0".join(tokens)).hexdigest(), pattern), spark.sparkContext.broadcast(tokens)  # the vocabulary, whatever the input

    def get() -> Codec:
        if key not in _CODECS:
            _CODECS.clear()
            _CODECS[key] = Codec(shared.value, pattern)
        return _CODECS[key]

    return get


def _digests(get: Callable[[], Codec]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = get()
        for batch in together(batches):
            n, ids_sha, text_sha = [], [], []
            texts = batch.column(1).to_pylist()
            codec.prepare(texts)
            for text in texts:
                ids = codec.packed(text)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                back = hashlib.sha256()
                for at in range(0, len(ids), 1 << 20):
                    back.update(codec.decode(np.frombuffer(ids[at : at + (1 << 20)], "<u4").tolist()))
                text_sha.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(get: Callable[[], Codec]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = get()
        for batch in together(batches):
            texts = batch.column(1).to_pylist()
            codec.prepare(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.encode(t) for t in texts], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids, the tokens of the whole text, for each row; null and empty texts have none."""
    return docs.select(F.col("doc_id").cast("long"), whole("text").alias("text")).mapInArrow(_ids(_codec(docs.sparkSession, ranks, pattern)), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded text.

    Null counts as the empty text, which has no tokens. Repeated rows are repeated, an empty table gives no rows, further
    columns are ignored. Rows stay where they are read: nothing is shuffled.
    """
    return docs.select(F.col("doc_id").cast("long"), whole("text").alias("text")).mapInArrow(_digests(_codec(docs.sparkSession, ranks, pattern)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
