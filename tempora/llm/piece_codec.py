"""SentencePiece encoding and decoding with a given model file: batched Viterbi in numpy.

The segmentation of a word is the one with the largest sum of piece scores; of equal sums the one
whose last piece is longest.  All texts of a batch become one array of code points; it is cut into
words (at a blank after a non-blank, and around line feeds, which no piece crosses), equal words are
segmented once, and words of one length advance together: at each end position the rolling hashes of all
substrings up to the longest piece are probed in the sorted array of piece hashes, and a maximum over
the lengths stores the best score and the backpointer.  Every substring that counts as a piece is
compared with that piece, so a hash collision can't change a result.

The file's pieces, scores and byte pieces are read; a vocabulary whose file was made for merging (BPE) is
segmented by its scores as well, so ids may differ from those of a merging encoder, while decoding
gives back the text in either case.  A character no piece covers becomes its UTF-8 byte pieces,
and so does a literal U+2581 (the mark that stands for a blank), so decoding is exact for any text.

Memory: texts are taken in chunks of bounded size, and words of a length in blocks; a longer text is a
chunk of its own.  The model is read once on the driver and sent as arrays (a vocabulary: a fixed size).

Defined results: null gives null ids, the empty text gives no ids; rows and other columns stay, whatever
their names; repeated rows are treated alike; an empty table gives an empty result; ids outside the
vocabulary can't be decoded and raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, give_back, mixed, table

BLANK = 0x2581
CHUNK_CHARS, BLOCK_CELLS = 1_000_000, 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Pieces:
    """A vocabulary as arrays; ``keys`` are sorted."""

    keys: np.ndarray  # hashes of the pieces
    ids: np.ndarray
    scores: np.ndarray
    points: np.ndarray  # code points of the pieces, padded to the longest
    lengths: np.ndarray
    longest: int
    byte_ids: np.ndarray  # by byte
    unknown: float  # score of a character no piece covers
    texts: list[bytes]  # by id, what decoding gives

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        byte_ids, plain, texts = np.full(256, -1, np.int32), [], [b""] * n
        for i in range(n):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
                texts[i] = bytes([int(p[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                score = model.get_score(i)
                plain.append((p, i, score))
                texts[i] = p.replace("▁", " ").encode()
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        if any("\n" in p and len(p) > 1 or "▁" in p.lstrip("▁") for p, _, _ in plain):
            raise ValueError("pieces that cross a line feed or the end of a word are not supported")
        longest = max(len(p) for p, _, _ in plain)
        points = np.zeros((len(plain), longest), np.uint32)
        for row, (p, _, _) in enumerate(plain):
            points[row, : len(p)] = [ord(c) for c in p]
        lengths = np.array([len(p) for p, _, _ in plain])
        keys = np.array([substring_hash(points[r, :k]) for r, k in enumerate(lengths)], np.uint64)
        order = np.argsort(keys, kind="stable")
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        scores = np.array([s for _, _, s in plain])
        usual = scores[scores > -1e5]
        return cls(keys[order], np.array([i for _, i, _ in plain], np.int32)[order], scores[order], points[order], lengths[order], longest, byte_ids, float(usual.min()) - 10.0, texts)


def substring_hash(points: np.ndarray) -> np.uint64:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for x in mixed(points.astype(np.uint64)):
            h = h * BASE + x
    return h


def viterbi(words: np.ndarray, v: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Words of one length (rows of code points): for each end, the last piece's length and its row in ``v`` (-1: none)."""
    m, n = words.shape
    x = mixed(words.astype(np.uint64))
    prefix = np.zeros((n + 1, m), np.uint64)
    for i in range(n):
        prefix[i + 1] = prefix[i] * BASE + x[:, i]
    power = [np.uint64(1)]
    with np.errstate(over="ignore"):
        for _ in range(v.longest):
            power.append(power[-1] * BASE)
    best = np.full((n + 1, m), -np.inf)
    best[0] = 0
    size, piece = np.zeros((n + 1, m), np.int16), np.full((n + 1, m), -1, np.int32)
    for end in range(1, n + 1):
        k = np.arange(min(end, v.longest), 0, -1)  # the longest first, so that it wins ties
        key = prefix[end][None, :] - prefix[end - k] * np.array([power[j] for j in k])[:, None]
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        hit = (v.keys[at] == key) & (v.lengths[at] == k[:, None])
        score = np.where(hit, v.scores[at], -np.inf)
        alone = np.where(hit[-1], score[-1], v.unknown)
        score[-1] = np.where((words[:, end - 1] == 0xFFFFFFFF), v.unknown, alone)
        total = best[end - k] + score
        win = np.argmax(total, axis=0)
        rows = np.arange(m)
        best[end], size[end] = total[win, rows], k[win]
        piece[end] = np.where(hit[win, rows], at[win, rows], -1)
    return size, piece


def segment(words: np.ndarray, v: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words of one length, one word after the other, and how many each has."""
    m, n = words.shape
    size, piece = viterbi(words, v)
    at, found = np.full(m, n), []
    rows = np.arange(m)
    while len(rows):
        k, p = size[at[rows], rows].astype(np.int64), piece[at[rows], rows]
        found.append((rows, at[rows] - k, k, p))
        at[rows] -= k
        rows = rows[at[rows] > 0]
    row, begin, k, p = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((begin, row))
    row, begin, k, p = row[order], begin[order], k[order], p[order]
    good = p >= 0
    for j in range(v.longest):  # every piece is compared with what it stands for
        used = good & (k > j)
        if (v.points[p[used], j] != words[row[used], begin[used] + j]).any():
            raise ValueError("two strings have one hash")
    single = np.where(good, v.ids[np.maximum(p, 0)], -1)
    if good.all():
        return single.astype(np.int32), np.bincount(row, minlength=m)
    chars = words[row[~good], begin[~good]]
    points = np.where(chars == 0xFFFFFFFF, BLANK, chars)
    coded = [np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8) for c in points.tolist()]
    count = np.ones(len(row), np.int64)
    count[~good] = [len(c) for c in coded]
    out = np.repeat(single, count).astype(np.int32)
    out[np.repeat(~good, count)] = v.byte_ids[np.concatenate(coded)]
    return out, np.bincount(row, weights=count, minlength=m).astype(np.int64)


def encode_texts(texts: list[str], v: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and where each text begins (one more entry than texts)."""
    marked = [f" {t}" if t else "" for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    points[points == BLANK] = 0xFFFFFFFF  # a literal mark: no piece
    points[points == 0x20] = BLANK
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in marked])])
    cut = np.zeros(len(points) + 1, bool)
    blank, feed = points == BLANK, points == 0x0A
    cut[1:-1] = (blank[1:] & ~blank[:-1]) | feed[1:] | feed[:-1]
    cut[bounds] = True
    edge = np.flatnonzero(cut)
    begin, length = edge[:-1], np.diff(edge)
    # equal words once: a hash of each word, by sums of hashes of (code point, place in the word)
    place = np.arange(len(points)) - np.repeat(begin, length)
    key = mixed(np.add.reduceat(mixed(points.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))), begin) + length.astype(np.uint64))
    _, sample, which = np.unique(key, return_index=True, return_inverse=True)
    sizes, parts, counts = length[sample], [], np.zeros(len(sample), np.int64)
    order = np.argsort(sizes, kind="stable")
    group = np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1)
    where = []
    for own in group:
        n = int(sizes[own[0]])
        step = max(1, BLOCK_CELLS // (n * v.longest))
        for lo in range(0, len(own), step):
            some = own[lo : lo + step]
            ids, count = segment(points[begin[sample[some]][:, None] + np.arange(n)], v)
            parts.append(ids)
            counts[some] = count
            where.append(some)
    flat, sequence = np.concatenate(parts), np.concatenate(where)
    first = np.zeros(len(sample), np.int64)
    first[sequence] = np.concatenate([[0], np.cumsum(counts[sequence])])[:-1]
    n = counts[which]
    total = np.concatenate([[0], np.cumsum(n)])
    ids = flat[np.repeat(first[which] - total[:-1], n) + np.arange(total[-1])]
    return ids, total[np.searchsorted(begin, bounds)]


def decode_ids(ids: np.ndarray, v: Pieces) -> str:
    """The text of ids; the blank before the first word goes. Ids that the model does not have are an error."""
    if len(ids) and not 0 <= ids.min() <= ids.max() < len(v.texts):
        raise ValueError(f"ids outside 0 to {len(v.texts) - 1}")
    return b"".join([v.texts[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass").removeprefix(" ")


def decoder(v: Pieces):
    """A pandas function: arrays of ids to texts."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or pd.isna(x).any() else decode_ids(np.asarray(x, np.int64), v) for x in ids], dtype=object)

    return decode


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", ids: str = "ids", exact: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` in the column ``ids`` and, if named, whether they decode to the text in ``exact``."""
    v = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    kept = [c for c in docs.columns if c not in (ids, exact)]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    place = kept.index(text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.utf8_length(b.column(place)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(sizes, CHUNK_CHARS):  # each chunk goes out at once, so that no batch's ids are held together
                part = b.slice(lo, hi - lo)
                texts = part.column(place).to_pylist()
                flat, at = encode_texts([t or "" for t in texts], v.value)
                null = pa.array([t is None for t in texts], pa.bool_())
                columns = [*part.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()), mask=null)]
                if exact:
                    columns.append(pa.array([None if t is None else decode_ids(flat[at[i] : at[i + 1]], v.value) == t for i, t in enumerate(texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, ids, *([exact] if exact else [])])
            give_back()

    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(exact, T.BooleanType())] if exact else [])]
    return rows.mapInArrow(of, T.StructType([*rows.schema.fields, *added]))


def decode(docs: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with the text of ``ids`` in the column ``text``."""
    return docs.withColumn(text, decoder(Pieces.load(model))(F.col(f"`{ids}`")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document's ids, their number, and whether decoding gives the text back."""
    docs = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), exact="exact")
    return docs.select("doc_id", "ids", F.size("ids").alias("n_tokens"), "exact")
