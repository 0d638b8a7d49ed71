"""Subject areas of documents by seeded non-negative matrix factorisation.

The document-term matrix (terms hashed to ``TERMS`` columns, weighted by
inverse document frequency) is factored by alternating multiplicative updates
into documents by components and components by terms.  One component is
anchored to each subject: it starts from the documents that desks have labelled
with it, and labelled documents may use no other subject's component.  A few
free components take up what belongs to no subject.  Each language has a block
of columns and components of its own, as texts of different languages share no
words and one component could not fit both.

The components then give each sentence its subject mixture, and a document's
areas are those to which at least ``share`` of its sentences belong.

Equal texts are one row of the matrix; they are told by 128 bits of hashes, and
their copies get the result by a join of these.  Each text is split and its terms
are hashed once; the passes work on whole batches of rows at a time.

The component matrix has a fixed size (``(subjects + FREE) * BLOCKS * TERMS``
floats, 16 MB for ten subjects, whatever the size of the corpus); terms that share
a column count as one, which the weights by specificity make harmless unless both
are frequent.  The tasks' parts of the sums are added up in a tree of two levels.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.text import fold, mend
from quillon.runtime import deal, drop_table, table

#: Columns of the hashed term matrix in each language's block.
TERMS = 1 << 15
# Frequent function words of languages written in Latin letters, without accents.
FUNCTION_WORDS = {
    "en": "the of and to in is was that for on with as at by it from are not be were have has had their which this won't isn't didn't nobody who after".split(),
    "de": "der die das und ist nicht den von mit dem des ein eine fur auf auch aus wurde im nach wird sich uber sie als noch bei gibt".split(),
    "fr": "le la les des et est dans du une au aux pour sur que qui par ne pas plus avec ce sont d'une l'affaire alors selon en".split(),
    "es": "el los las del y es en una por con para que se no al su mas sobre de si hay sigue siendo nadie estamos".split(),
    "it": "il lo gli della di che e per con non una sono nel alla piu dei delle si da".split(),
    "nl": "de het een van en dat niet voor met zijn op aan ook naar wordt bij uit".split(),
}
_LATIN = {w: g for g, ws in enumerate(FUNCTION_WORDS.values()) for w in ws if sum(w in x for x in FUNCTION_WORDS.values()) == 1}
_SCRIPTS = (re.compile("[Ѐ-ӿ]"), re.compile("[؀-ۿ]"), re.compile("[぀-ヿ㐀-鿿가-힯]"))
#: Languages told apart: those above, and one block for each of three other scripts.
BLOCKS = len(FUNCTION_WORDS) + len(_SCRIPTS)
COLUMNS = BLOCKS * TERMS
#: Components that are no subject's.
FREE = 4
PIECE = 1 << 13

_SPLIT = re.compile(r"(?<=[.!?。！？؟])[\"”“»’')]*\s+|(?<=[。！？])|[\n\r]+")
_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")
_URL = re.compile(r"(?:https?|ftp)://\S+|www\.\S+")
#: Lines of code, hashes, addresses of machines and paths.
_CODE = re.compile(r"[{}]|\w\s?[=<>]=|\)\s*;|;\s*//|=>|\b[0-9a-fA-F]{16,}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[A-Za-z]:\\|^\s*(?:[=*_#-]\s?){6,}")


def _column(term: str) -> int:
    return zlib.crc32(term.encode("utf-8")) % TERMS


class Columns(dict):
    """Columns of words, kept for a worker's life: the word's own and that of its beginning, -1 for none."""

    def __missing__(self, w: str) -> tuple[int, int]:
        if len(self) > 1 << 20:
            self.clear()
        x = self[w] = (_column(w) if len(w) > 1 else -1, _column("^" + w[:5]) if len(w) > 6 else -1)
        return x


_COLUMNS = Columns()


def words_of(s: str) -> list[str]:
    """Folded words of a text; of scripts without spaces, pairs of characters."""
    if "&" in s:
        s = html.unescape(s)
    out = []
    for w in _WORD.findall(fold(s) if not _WIDE.search(s) else s.lower()):
        if _WIDE.search(w):
            chars = [c for c in w if _WIDE.match(c)]
            out += [a + b for a, b in zip(chars, chars[1:])]
        else:
            out.append(w)
    return out


def language_of(text: str | None, words: list[list[str]] | None = None) -> int:
    """Block of a text's language: by its script, and in Latin letters by the function words of all its sentences; English if nothing tells."""
    t = mend(text or "")
    if not t.isascii():
        letters = sum(map(str.isalpha, t)) or 1
        for i, r in enumerate(_SCRIPTS):
            if len(r.findall(t)) * (3 if i == 2 else 1) > letters * 0.45:
                return len(FUNCTION_WORDS) + i
    n = [0] * len(FUNCTION_WORDS)
    for ws in sentences(text) if words is None else words:
        for w in ws:
            if w in _LATIN:
                n[_LATIN[w]] += 1
    return int(np.argmax(n))


def columns_of(sents: list[list[str]], block: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Term columns of sentences in a language's block, and the sentence of each: words, their beginnings, and pairs of neighbours."""
    pairs = [_COLUMNS[w] for ws in sents for w in ws]
    both = np.array(pairs, np.int64).reshape(-1, 2)
    of = np.repeat(np.arange(len(sents)), [len(ws) for ws in sents])
    own, start = both[:, 0], both[:, 1]
    next_to = of[:-1] == of[1:]
    mixed = ((own[:-1] + 1) * 40503 + (own[1:] + 1) * 2654435761 + 97) % 4294967291 % TERMS
    cols = np.concatenate([own, start, mixed[next_to]])
    sent = np.concatenate([of, of, of[1:][next_to]])
    keep = cols >= 0
    return cols[keep] + block * TERMS, sent[keep]


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence of a text; fragments of fewer than three words and code are none."""
    out = []
    for s in _SPLIT.split(_URL.sub(" ", mend(text or ""))):
        if s and not _CODE.search(s):
            ws = words_of(s)
            if len(ws) >= 3:
                out.append(ws)
    return out


def mixtures(b: np.ndarray, gram: np.ndarray, allowed: np.ndarray | None = None, rounds: int = 12) -> np.ndarray:
    """Non-negative weights (components by rows) of rows whose products with the components are ``b``, by multiplicative updates with the components held."""
    w = np.ones_like(b) if allowed is None else allowed.astype(np.float32)
    for _ in range(rounds):
        w = w * b / (gram @ w + 1e-6)
    return w


def _sums(x: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=x, minlength=n)


def _products(h: np.ndarray, at: np.ndarray, v: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Components by rows: the products of each row's terms with each component."""
    return np.stack([_sums(h[k, at] * v, row, n) for k in range(len(h))]).astype(np.float32) if len(h) else np.zeros((0, n), np.float32)


def _by_block(b: np.ndarray, grams: np.ndarray, blocks: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    w = np.zeros_like(b)
    for g in np.unique(blocks):
        at = np.flatnonzero(blocks == g)
        w[:, at] = mixtures(b[:, at], grams[g], None if allowed is None else allowed[:, at])
    return w


def _rows(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column and the row of each."""
    c = b.column(name)
    n = c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return c.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(b.num_rows), n)


def _unit(b: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, values of unit length per row, and rows of a batch of ``(at, n)``."""
    at, row = _rows(b, "at")
    v = np.log1p(_rows(b, "n")[0]) * idf[at]
    v = v / (np.sqrt(_sums(v * v, row, b.num_rows)) + 1e-9)[row]
    return at, v, row


def _marks(b: pa.RecordBatch, n_sub: int) -> np.ndarray:
    """Subjects by rows: 1 where desks have labelled the row with the subject."""
    out = np.zeros((n_sub, b.num_rows), np.float32)
    i, row = _rows(b, "marks")
    out[i, row] = 1
    return out


def _pieces(k: int, a: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    for row in range(k):
        for p in range(0, a.shape[1], PIECE):
            part = a[row, p : p + PIECE]
            if part.any():
                yield row, p // PIECE, part.astype(np.float32).tobytes()


_PIECES = "row int, piece int, salt int, data binary"


def _sum_piece(t: pa.Table) -> pa.Table:
    total = np.zeros(PIECE, np.float64)
    for x in t.column("data").to_pylist():
        part = np.frombuffer(x, np.float32)
        total[: len(part)] += part
    same = {c: pa.array([t.column(c)[0].as_py()], pa.int32()) for c in ("row", "piece", "salt")}
    return pa.table({**same, "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _gather(parts: DataFrame, k: int, width: int, tasks: int) -> np.ndarray:
    """The sums of the tasks' parts: each task sends its pieces with its number, so that no group holds more than the root of all tasks' parts."""
    salts = max(1, int(np.sqrt(tasks)))
    now = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    if salts > 4:
        now = now.groupBy("row", "piece", "salt").applyInArrow(_sum_piece, _PIECES)
    out = np.zeros((k, width), np.float32)
    for r in now.groupBy("row", "piece").applyInArrow(_sum_piece, _PIECES).toArrow().to_pylist():
        x = np.frombuffer(r["data"], np.float32)
        lo = r["piece"] * PIECE
        out[r["row"], lo : min(width, lo + PIECE)] = x[: min(width, lo + PIECE) - lo]
    return out


def _send(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        ["row", "piece", "salt", "data"],
    )


CODED = "k1 long, k2 long, marks array<int>, block int, at array<int>, n array<int>, cols array<int>, sents array<int>, sentences int"


def encode(texts: DataFrame) -> DataFrame:
    """Terms of distinct ``(k1, k2, text, marks)``: the row's columns ``at`` with their counts ``n``, and each occurrence ``cols`` with its sentence ``sents``."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, at, n, cols, sents, count = [], [], [], [], [], []
            for x in b.column(2).to_pylist():
                ss = sentences(x)
                g = language_of(x, ss)
                c, s = columns_of(ss, g)
                u, k = np.unique(c, return_counts=True)
                for out, value in ((blocks, g), (at, u.astype(np.int32)), (n, k.astype(np.int32)), (cols, c.astype(np.int32)), (sents, s.astype(np.int32)), (count, len(ss))):
                    out.append(value)
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), pa.array(blocks, pa.int32()), *(pa.array(x, lists) for x in (at, n, cols, sents)), pa.array(count, pa.int32())],
                ["k1", "k2", "marks", "block", "at", "n", "cols", "sents", "sentences"],
            )

    return texts.mapInArrow(code, CODED)


def learn(coded: DataFrame, n_sub: int, *, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Components by terms and the inverse document frequencies, from the written rows of :func:`encode`."""
    spark = coded.sparkSession
    k = n_sub + FREE
    rows = coded.select("k1", "marks", "block", "at", "n")
    tasks = rows.rdd.getNumPartitions()  # of a scan

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, COLUMNS), np.float32)
        for b in batches:
            n[0] += np.bincount(_rows(b, "at")[0], minlength=COLUMNS)
            n[1, :BLOCKS] += np.bincount(b.column("block").to_numpy(), minlength=BLOCKS)
        yield _send(list(_pieces(2, n)))

    df = _gather(rows.mapInArrow(frequencies, _PIECES), 2, COLUMNS, tasks)
    total = np.repeat(df[1, :BLOCKS], TERMS)
    idf = np.where(df[0] >= 2, np.log((total + 1) / (df[0] + 0.5)), 0.0).clip(0).astype(np.float32)
    shared_idf = spark.sparkContext.broadcast(idf)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((k, COLUMNS), np.float32)
        for b in batches:
            at, v, row = _unit(b, shared_idf.value)
            m = _marks(b, n_sub)
            m /= np.maximum(1, m.sum(0))
            for i in range(n_sub):
                on = m[i, row] > 0
                a[i] += np.bincount(at[on], weights=v[on] * m[i, row[on]], minlength=COLUMNS)
            free = b.column("k1").to_numpy() % FREE  # by the text's hash, however the rows are dealt
            for i in range(FREE):
                on = free[row] == i
                a[n_sub + i] += np.bincount(at[on], weights=v[on] * 0.02, minlength=COLUMNS)
        yield _send(list(_pieces(k, a)))

    h = _gather(rows.mapInArrow(start, _PIECES), k, COLUMNS, tasks).reshape(k, BLOCKS, TERMS)
    # terms that labels of several subjects share say little of any
    if n_sub:
        top = h[:n_sub]
        h[:n_sub] = top * (top / (top.sum(0, keepdims=True) + 1e-9)) ** 0.5
    mean = h.sum(0) / k
    h = _scaled(h) + 0.02 * mean / (np.linalg.norm(mean, axis=-1, keepdims=True) + 1e-9)
    for _ in range(rounds):
        h = _scaled(h).astype(np.float32)
        shared = spark.sparkContext.broadcast(h)

        def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h = shared.value
            grams = np.stack([h[:, g] @ h[:, g].T for g in range(BLOCKS)])
            flat = h.reshape(k, COLUMNS)
            a = np.zeros((k, COLUMNS), np.float32)
            g = np.zeros((k, BLOCKS, k), np.float32)
            for b in batches:
                at, v, row = _unit(b, shared_idf.value)
                blocks, m = b.column("block").to_numpy(), _marks(b, n_sub)
                told = m.any(0) if n_sub else np.zeros(b.num_rows, bool)
                allowed = np.vstack([np.where(told, m, 1), np.ones((FREE, b.num_rows))]).astype(np.float32)
                w = _by_block(_products(flat, at, v, row, b.num_rows), grams, blocks, allowed)
                heavy = w * np.where(told, 4.0, 1.0)  # what desks have read counts more
                for i in range(k):
                    a[i] += np.bincount(at, weights=heavy[i, row] * v, minlength=COLUMNS)
                for x in np.unique(blocks):
                    g[:, x] += heavy[:, blocks == x] @ w[:, blocks == x].T
            wide = np.zeros((k, COLUMNS), np.float32)
            wide[:, : BLOCKS * k] = g.reshape(k, -1)
            yield _send([*_pieces(k, a), *((r + k, p, d) for r, p, d in _pieces(k, wide))])

        both = _gather(rows.mapInArrow(update, _PIECES), 2 * k, COLUMNS, tasks)
        g = both[k:, : BLOCKS * k].reshape(k, BLOCKS, k)
        for x in range(BLOCKS):
            h[:, x] *= both[:k, x * TERMS : (x + 1) * TERMS] / (g[:, x] @ h[:, x] + 1e-6)
        shared.destroy()  # the round has been summed; its file on the driver goes too
    shared_idf.destroy()
    return _scaled(h).astype(np.float32), idf


def _scaled(h: np.ndarray) -> np.ndarray:
    """Components of unit length in each block."""
    return h / (np.linalg.norm(h, axis=-1, keepdims=True) + 1e-9)


def document_subjects(
    docs: DataFrame, labels: DataFrame, areas: DataFrame, *, share: float = 0.18, least: float = 0.5, rounds: int = 6
) -> DataFrame:
    """``(doc_id, subject)``: the areas to which at least ``share`` of the sentences of a text belong.

    A sentence belongs to the subject whose component carries at least ``least``
    of its mixture, if enough of its terms are some subject's.  Null, empty and blank texts, and
    texts without a sentence, have no subject; labels of unknown documents or
    subjects are ignored; with no subjects or no labels nothing is found.
    Repeated rows give one row per subject.  There may be any number of subjects;
    the components grow with it.
    """
    spark = docs.sparkSession
    subjects = sorted(r.subject for r in areas.where(F.col("subject").isNotNull()).select("subject").distinct().collect())  # the areas are configured, some dozens
    place = spark.createDataFrame(list(zip(subjects, range(len(subjects)))), "subject string, i int")
    marks = labels.select("doc_id", "subject").join(place, "subject").groupBy("doc_id").agg(F.collect_set("i").alias("m"))  # at most the subjects
    text = F.col("text").cast("string")
    keys = {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}
    base = docs.select("doc_id", text.alias("text")).where(F.length(F.trim("text")) > 0).withColumns(keys)
    told = base.select("doc_id", "k1", "k2").join(marks, "doc_id").select("k1", "k2", F.explode("m").alias("i")).groupBy("k1", "k2").agg(F.collect_set("i").alias("m"))
    once = base.groupBy("k1", "k2").agg(F.any_value("text").alias("text")).join(told, ["k1", "k2"], "left")
    none = F.array().cast("array<int>")
    coded = table(encode(deal(once.select("k1", "k2", "text", F.coalesce("m", none).alias("marks")))), "terms")
    h, idf = learn(coded, len(subjects), rounds=rounds)
    model = spark.sparkContext.broadcast(Model(h, idf, len(subjects), least))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("sentences").to_numpy()
            row, i = model.value.areas(*_rows(b, "cols"), _rows(b, "sents")[0], b.column("block").to_numpy(), n, share)
            yield pa.RecordBatch.from_arrays([b.column("k1").take(pa.array(row)), b.column("k2").take(pa.array(row)), pa.array([subjects[x] for x in i], pa.string())], ["k1", "k2", "subject"])

    found = coded.select("k1", "k2", "block", "cols", "sents", "sentences").mapInArrow(find, "k1 long, k2 long, subject string")
    return base.select("doc_id", "k1", "k2").distinct().join(found, ["k1", "k2"]).select("doc_id", "subject").distinct()


class Model:
    """The components as a worker uses them.

    A term counts in a sentence by how much of it belongs to one subject's
    component, so that the words of any sentence of a language do not decide.
    """

    def __init__(self, h: np.ndarray, idf: np.ndarray, n_sub: int, least: float, *, floor: float = 0.3, told: float = 1.5, rare: float = 0.1):
        self.n_sub, self.least, self.told = n_sub, least, told
        total = h.sum(0)
        some = total.sum(-1, keepdims=True) / np.maximum(1, (total > 0).sum(-1, keepdims=True))
        one = h[:n_sub].max(0) / (total + rare * some + 1e-9) if n_sub else np.zeros_like(total)
        self.weight = (idf * np.clip((one - floor) / (0.8 - floor), 0, 1).reshape(-1)).astype(np.float32)
        self.grams = np.stack([h[:n_sub, g] @ h[:n_sub, g].T for g in range(BLOCKS)])
        self.flat = h[:n_sub].reshape(n_sub, -1)

    def sentence_areas(self, cols: np.ndarray, sent: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Index of the subject of each sentence, -1 for none; ``blocks`` has each sentence's language."""
        out = np.full(len(blocks), -1)
        if not len(cols) or not self.n_sub:
            return out
        keep = self.weight[cols] > 0  # most terms are no subject's
        key, n = np.unique(sent[keep].astype(np.int64) * COLUMNS + cols[keep], return_counts=True)
        at, s = key % COLUMNS, key // COLUMNS
        v = np.log1p(n) * self.weight[at]
        strong = np.flatnonzero(_sums(v, s, len(blocks)) >= self.told)
        if not len(strong):
            return out
        to = np.full(len(blocks), -1)
        to[strong] = np.arange(len(strong))
        on = to[s] >= 0
        at, s, v = at[on], to[s[on]], v[on]
        v = v / np.sqrt(_sums(v * v, s, len(strong)))[s]
        w = _by_block(_products(self.flat, at, v, s, len(strong)), self.grams, blocks[strong])
        top = w.argmax(0)
        out[strong] = np.where(w.max(0) >= self.least * w.sum(0), top, -1)
        return out

    def areas(self, cols: np.ndarray, row: np.ndarray, sents: np.ndarray, blocks: np.ndarray, n: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """``(row, subject)`` of the texts of a batch: subjects to which at least ``share`` of a text's ``n`` sentences belong."""
        first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(n)), n)
        found = self.sentence_areas(cols, first[row] + sents, blocks[of])
        counts = np.zeros((len(n), max(1, self.n_sub)))
        np.add.at(counts, (of[found >= 0], found[found >= 0]), 1)
        return np.nonzero((counts > 0) & (counts >= share * n[:, None]))
