"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter trigram is bound by
multiplying the vectors of its letters, permuted by their place (rolled twice,
once, not at all), a text is the bundle (sum) of its trigrams, and a language's
prototype is the bundle of its training texts.  A text gets the language whose
prototype has the largest cosine with it; the cosine is the score.

Training sums trigram counts per language in each task and bundles once per
task; the sums meet in two steps, so the driver gets one vector per language.
All sums are of whole numbers, so reruns and retries agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import bounded_batches, cut, passes_columns
from barsmith.llm.shingles import grouped

DIM = 1024
#: letters are told apart by 128 symbols: none, a-z, U+00DF to U+00FF, and 68
#: that all other letters share by hash
SYMBOLS, LATIN, OTHER = 128, 27, 60
#: trigram vectors that a task remembers, and that it adds up at a time
VECTORS, SLAB = 16_000, 2_048
#: labelled texts of a language and size from which a bound is taken, and how
#: far below the quartiles it lies
JUDGED, FENCE = 50, 3
UNKNOWN = "und"


def symbol_table() -> np.ndarray:
    """Symbol of every code point; 0 for all that is no letter."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            if 97 <= c <= 122:
                table[c] = c - 96
            elif 0xDF <= c <= 0xFF:
                table[c] = LATIN + c - 0xDF
            else:
                table[c] = OTHER + (c * 2654435761 >> 7) % (SYMBOLS - OTHER)
    return table


def trigrams(text: str | None, table: np.ndarray) -> np.ndarray:
    """Codes of all trigrams around a letter; word edges count as a symbol."""
    if not text:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.zeros(len(codes) + 2, np.int64)
    s[1:-1] = table[codes]
    s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]
    t = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    return t[s[1:-1] != 0]


class Vectors:
    """Bound vectors of the trigrams that a task has met."""

    def __init__(self, dim: int, seed: int = 7):
        letters = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dim), np.int8) * 2 - 1
        self.c, self.b, self.a = letters, np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
        self.row = np.full(SYMBOLS ** 3, -1, np.int32)
        self.rows, self.n = np.zeros((1024, dim), np.int8), 0

    def index(self, codes: np.ndarray) -> np.ndarray:
        new = codes[self.row[codes] < 0]
        if len(new):
            new = np.unique(new)
            while self.n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            a, bc = np.divmod(new, SYMBOLS * SYMBOLS)
            b, c = np.divmod(bc, SYMBOLS)
            self.rows[self.n:self.n + len(new)] = self.a[a] * self.b[b] * self.c[c]
            self.row[new] = np.arange(self.n, self.n + len(new), dtype=np.int32)
            self.n += len(new)
        return self.row[codes]

    def forget(self) -> None:
        if self.n > VECTORS:
            self.row[:], self.n = -1, 0

    def bundle(self, codes: np.ndarray) -> np.ndarray:
        """Sum of the vectors of all trigrams, ``SLAB`` distinct ones at a time;
        where very many are new, no more than a slab of them is held either."""
        total = np.zeros(self.rows.shape[1])
        if (self.row[codes] < 0).sum() <= VECTORS:
            counts = np.bincount(self.index(codes))
            at = np.flatnonzero(counts)
            for i in range(0, len(at), SLAB):
                part = at[i:i + SLAB]
                total += self._sum(counts[part], part)
            return total
        distinct, counts = np.unique(codes, return_counts=True)
        for i in range(0, len(distinct), SLAB):
            total += self._sum(counts[i:i + SLAB], self.index(distinct[i:i + SLAB]))
            self.forget()
        return total

    def _sum(self, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """In single precision while that is exact."""
        kind = np.float32 if counts.sum() < 1 << 24 else np.float64
        return (counts.astype(kind) @ self.rows[rows].astype(kind)).astype(np.float64)


def _train_task(dim: int, shared):
    def run(batches: Iterator[pa.RecordBatch]):
        table, vectors, sums, held = shared.value, Vectors(dim), {}, {}

        def settle():
            for lang, codes in held.items():
                sums[lang] = sums.get(lang, 0) + np.rint(vectors.bundle(np.concatenate(codes))).astype(np.int64)
                vectors.forget()
            held.clear()
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = trigrams(text.as_py(), table)
                if len(codes):
                    held.setdefault(lang, []).append(codes)
                    size += len(codes)
                if size > 1 << 21:
                    settle()
                    size = 0
        settle()
        if sums:
            part = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array(list(sums)), "part": pa.array([part] * len(sums), pa.int32()),
                "vec": pa.array([v.tobytes() for v in sums.values()], pa.binary())})
    return run


def _sum_task(batches: Iterator[pa.RecordBatch]):
    for (lang, part), rows in grouped(batches, ["lang", "part"]):
        total = sum(np.frombuffer(v, np.int64) for v in rows.column("vec").to_pylist())
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "part": pa.array([part], pa.int32()),
                                          "vec": pa.array([total.tobytes()], pa.binary())})


def train(rows: DataFrame, lang: str, text: str, dim: int = DIM) -> dict:
    """Prototypes of the non-null languages of the rows.  What reaches the
    driver is one vector per language."""
    spark = rows.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(symbol_table())
    kinds = "lang string, part int, vec binary"
    sums = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), text)
    sums = sums.mapInArrow(_train_task(dim, shared), kinds)
    for part in (F.col("part"), F.lit(0)):
        sums = sums.withColumn("part", part.cast("int")).repartition("lang", "part") \
            .sortWithinPartitions("lang", "part").mapInArrow(_sum_task, kinds)
    found = sorted((r["lang"], np.frombuffer(bytes(r["vec"]), np.int64)) for r in cut(sums).collect())
    found = [(k, v.astype(np.float64)) for k, v in found if v.any()]
    return {"dim": dim, "langs": [k for k, _ in found], "symbols": shared,
            "norms": {k: float(np.linalg.norm(v)) for k, v in found},
            "prototypes": np.array([v / np.linalg.norm(v) for _, v in found]).reshape(len(found), dim)}


def predictor(spark, model: dict):
    """A column function: text to ``struct<lang: string, score: double, known:
    boolean>``; ``known`` says that the text has letters and that its score is
    not below the bound of the model, if the model has ``bounds``."""
    symbols = model["symbols"]
    shared = spark.sparkContext.broadcast({k: model.get(k, {}) for k in ("dim", "langs", "prototypes", "bounds")})

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, table = shared.value, symbols.value
        vectors = Vectors(m["dim"])
        for batch in texts:
            langs, scores, known = [], [], []
            for text in batch:
                codes = trigrams(text.as_py(), table)
                if not len(codes) or not m["langs"]:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    known.append(bool(len(codes)))
                    continue
                v = vectors.bundle(codes)
                vectors.forget()
                cos = m["prototypes"] @ v / max(np.linalg.norm(v), 1e-9)
                best = int(np.argmax(cos))
                langs.append(m["langs"][best])
                scores.append(float(min(1.0, max(0.0, cos[best]))))
                low = m["bounds"].get(langs[-1], {})
                size = max((x for x in low if x <= _size(codes)), default=None)
                known.append(size is None or scores[-1] >= low[size])
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                                              pa.array(known, pa.bool_())], names=["lang", "score", "known"])
    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # evaluated once a row, whatever a plan does with its fields
    return F.arrow_udf(run, "struct<lang:string,score:double,known:boolean>").asNondeterministic()


def _size(codes: np.ndarray) -> int:
    """Texts are compared with texts of their size: bits of their trigram count."""
    return len(codes).bit_length()


def bounds(rows: DataFrame, lang: str, text: str, model: dict) -> dict:
    """Per language the lowest score of a text of each size, from the scores of
    all training texts with their own language: ``FENCE`` times the distance of
    the quartiles below the lower one.  A text is left out of the prototype it
    is held against.  Scores grow with size: where a size has fewer than
    ``JUDGED`` texts, smaller ones count with it until there are as many, and a
    size without a bound takes that of the next smaller one.  What reaches the
    driver are counts by language, size and thousandths."""
    symbols = model["symbols"]
    shared = rows.sparkSession.sparkContext.broadcast({k: model[k] for k in ("dim", "langs", "norms", "prototypes")})

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m, table = shared.value, symbols.value
        vectors, number = Vectors(m["dim"]), {k: i for i, k in enumerate(m["langs"])}
        for texts, langs in columns:
            out = []
            for t, la in zip(texts, langs.to_pylist()):
                codes = trigrams(t.as_py(), table)
                if not len(codes) or la not in number:
                    out.append(None)
                    continue
                v = vectors.bundle(codes)
                vectors.forget()
                rest = m["prototypes"][number[la]] * m["norms"][la] - v
                cos = rest @ v / max(np.linalg.norm(rest) * np.linalg.norm(v), 1e-9)
                out.append({"size": _size(codes), "at": int(round(1000 * min(1.0, max(0.0, cos))))})
            yield pa.array(out, pa.struct([("size", pa.int32()), ("at", pa.int32())]))
    run.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    scored = F.arrow_udf(run, "struct<size:int,at:int>").asNondeterministic()
    counts = rows.select(F.col(lang).cast("string").alias("lang"), scored(F.col(text), F.col(lang).cast("string")).alias("s"))
    seen = {}
    for r in counts.where(F.col("s").isNotNull()).groupBy("lang", "s.size", "s.at").count().collect():
        seen.setdefault((r["lang"], r["size"]), []).append((r["at"], r["count"]))
    found, held = {}, {}
    for la, size in sorted(seen):
        pairs = held[la] = held.get(la, []) + seen[la, size]
        at, n = np.array(sorted(pairs)).T
        if n.sum() >= JUDGED:
            low, high = (int(at[np.searchsorted(np.cumsum(n), n.sum() * q)]) for q in (.25, .75))
            found.setdefault(la, {})[size] = (low - FENCE * (high - low)) / 1000
            held[la] = []
    return found


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id mod 4 is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@passes_columns
def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             dim: int = DIM) -> DataFrame:
    """Adds ``held_out``, ``lang_pred`` and ``score`` to the documents.

    Learns from text and language of the documents that are not held out.  Null
    texts and texts without letters get ``und`` and score 0, as does everything
    when nothing could be learned.  Equal cosines go to the language that sorts
    first.  A null id counts as the empty text.  Columns of the added names are
    replaced, all others passed on."""
    model = train(docs.where(~held_out(F.col(doc_id))), lang, text, dim)
    predict = predictor(docs.sparkSession, model)
    names = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    out = docs.withColumn("__held", held_out(F.col(doc_id))).withColumn("__pred", predict(F.col(text)))
    return out.select(*names, F.col("__held").alias("held_out"), F.col("__pred.lang").alias("lang_pred"),
                      F.col("__pred.score").alias("score"))


@passes_columns
def in_a_language(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                  dim: int = DIM) -> DataFrame:
    """The documents that are in a language, with ``lang_pred``: those with
    letters whose score reaches the bound (see :func:`bounds`) of the predicted
    language.  Texts smaller than any that has a bound stay, and so do all with
    letters when nothing could be learned (``lang_pred`` is ``und`` then)."""
    rows = docs.where(~held_out(F.col(doc_id)))
    model = train(rows, lang, text, dim)
    model["bounds"] = bounds(rows, lang, text, model) if model["langs"] else {}
    found = docs.withColumn("__pred", predictor(docs.sparkSession, model)(F.col(text))).where("__pred.known")
    return found.withColumn("lang_pred", F.col("__pred.lang")).drop("__pred")
