"""Quality rules with an n-gram perplexity model.

The model predicts the characters of a word from the ones before it: modified Kneser-Ney of
order 4 over UTF-16 units, with marks for the word's start and end. Spark counts the n-grams of
all documents and derives continuation counts, discounts, back-off weights and the probability
of each n-gram, all keyed by the exact n-gram. Up to ``FITS`` probabilities are broadcast; more are
joined with the n-grams of the distinct words, and the words with the documents, but for the
commonest ``HOT``, whose scores are broadcast. A document's perplexity is that of its words. Each
language has a band around its median, where each distinct text counts once: ``WIDTH`` deviations
to either side, each side's taken from the ``CORE`` of texts next to the median, so that junk does
not widen it, and wider for short texts, whose mean varies more; documents outside are rejected.

Defined results: null and empty texts have no words and fail the base rules; texts are read
whole; repeated rows count and are judged each; a null language is a language of its own;
languages with fewer than ``FEW`` distinct scored texts use the limits of all; an empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypanel.llm.common import KEY, batch_of, doc_key, same, slices, text_bytes
from tallypanel.llm.words import WordTable, starts_of, sums
from tallypanel.session import materialize

ORDER = 4
SYMBOL_BITS = 16  # of a UTF-16 unit; 1 and 2 mark a word's start and end
START, END = 1, 2
# What a text may hold of the marks, and U+FFFF, of which four would be the number of no n-gram:
# written as two low surrogates, which no text has side by side.
ESCAPED = {START: "\udc00\udc01", END: "\udc00\udc02", 0xFFFF: "\udc00\udc03"}
FITS = 1 << 22  # n-grams whose probabilities are broadcast
HOT = 1 << 18  # words whose scores are broadcast where the n-grams are not
WIDTH = 6.0
LEAST_LIMIT = 2.0
CORE, CORE_WIDTH = 0.1, 0.2533  # share of texts on a side, and its width in standard deviations
OWN_SPREAD, SYMBOL_SPREAD = 0.02, 1.5  # in nats: of a document's own, and of a symbol
FEW = 50
SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"
# A window of repeated words.
WINDOW = 8
_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def units(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 units of all words, each between a start and an end mark, and their lengths. A
    character above U+FFFF is two units, so different texts have different units."""
    texts = [w.decode("utf-8", "replace") for w in words]
    whole = "".join(texts)
    if whole and (max(whole) >= "\uffff" or "\x01" in whole or "\x02" in whole):
        texts = [t.translate(ESCAPED) for t in texts]
        lengths = np.fromiter((len(t) + sum(c > "\uffff" for c in t) + 2 for t in texts), np.int64, len(texts))
    else:
        lengths = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    raw = ("\x01" + "\x02\x01".join(texts) + "\x02").encode("utf-16-le", "surrogatepass")
    return np.frombuffer(raw, "<u2").astype(np.int64), lengths


def grams(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each symbol but the starts: its index, and the packed n-grams of 1 to ``ORDER``
    symbols that end at it; -1 where the word is too short for one. No n-gram is -1, as
    U+FFFF is escaped."""
    begin = np.repeat(starts_of(lengths), lengths)
    at = np.flatnonzero(np.arange(len(flat)) > begin)
    before = at - begin[at]
    packed, out = flat[at], [flat[at]]
    for n in range(1, ORDER):
        packed = packed | flat[np.maximum(at - n, 0)] << (SYMBOL_BITS * n)
        out.append(np.where(before >= n, packed, -1))
        packed = np.where(before >= n, packed, 0)
    return at, out


def _count(batches):
    """N-grams of the greatest order that each place allows, counted within the task."""
    schema = pa.schema([("n", pa.int32()), ("packed", pa.int64()), ("c", pa.int64())])

    def flush(words: dict[bytes, int]):
        flat, lengths = units(list(words))
        weight = np.fromiter(words.values(), np.int64, len(words))
        at, found = grams(flat, lengths)
        per = np.repeat(weight, lengths - 1)
        done = np.zeros(len(at), bool)
        for n in range(ORDER, 1, -1):
            here = (found[n - 1] != -1) & ~done
            done |= here
            keys, back = np.unique(found[n - 1][here], return_inverse=True)
            if len(keys):
                c = np.bincount(back, per[here]).astype(np.int64)
                yield batch_of(schema, np.full(len(keys), n, np.int32), keys, c)

    words: dict[bytes, int] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            for text in part.column("text").to_pylist():
                for word in text.split():
                    words[word] = words.get(word, 0) + 1
            if len(words) > 250_000:
                yield from flush(words)
                words = {}
    if words:
        yield from flush(words)


Arrays = tuple[np.ndarray, np.ndarray]


def greatest(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol but the starts: the greatest order its place allows, and that n-gram."""
    _, found = grams(flat, lengths)
    order, packed = np.ones(len(found[0]), np.int32), found[0].copy()
    for n in range(2, ORDER + 1):
        there = found[n - 1] != -1
        order[there], packed[there] = n, found[n - 1][there]
    return order, packed


@dataclass
class Model:
    """``scores`` holds ``n, packed, logp`` of the greatest n-gram of each place in any word of
    the counted documents, ``n_grams`` of them; ``tables`` for each order the discounted
    probabilities ``packed, value`` and the weights of the next lower order by context."""

    scores: DataFrame
    n_grams: int
    tables: list[tuple[DataFrame, DataFrame]]
    floor: float

    @cached_property
    def grams(self) -> list[Arrays]:
        """Sorted n-grams and values on the driver, to look into a small model."""
        return [_arrays(own) for own, _ in self.tables]

    @cached_property
    def contexts(self) -> list[Arrays]:
        return [_arrays(back) for _, back in self.tables]


def _find(table: Arrays, packed: np.ndarray, otherwise: float) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.full(len(packed), otherwise)
    at = np.minimum(np.searchsorted(keys, packed), len(keys) - 1)
    return np.where(keys[at] == packed, values[at], otherwise)


class Known:
    """Natural log probability of words, and their symbols with the end, from broadcast
    probabilities by order."""

    def __init__(self, logs: dict[int, Arrays], least: float):
        self.logs, self.least = logs, least

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0), np.zeros(0, np.int64)
        flat, lengths = units(words)
        order, packed = greatest(flat, lengths)
        logp = np.full(len(order), self.least)
        for n, table in self.logs.items():
            here = order == n
            logp[here] = _find(table, packed[here], self.least)
        return sums(logp, lengths - 1), lengths - 1


class HotWords:
    """Scores of the commonest words; others have 0 symbols here and are joined."""

    def __init__(self, words: list[bytes], scores: np.ndarray, symbols: np.ndarray):
        self.known = {w: (x, int(n)) for w, x, n in zip(words, scores.tolist(), symbols.tolist())}

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.known.get(w, (0.0, 0)) for w in words]
        return np.array([x for x, _ in found], float), np.array([n for _, n in found], np.int64)


def _lower(tables: dict[int, DataFrame], raw: DataFrame, n: int) -> DataFrame:
    """Counts of order ``n``: continuation counts, and plain counts at word starts."""
    starts = raw.where(F.col("n") == n).select("packed", "c")
    mask = (1 << (SYMBOL_BITS * n)) - 1
    suffix = tables[n + 1].select(F.col("packed").bitwiseAND(F.lit(mask)).alias("packed"))
    heard = suffix.groupBy("packed").agg(F.count("*").alias("c"))
    return heard.unionByName(starts).groupBy("packed").agg(F.sum("c").alias("c")) if n > 1 else heard


def fit(docs: DataFrame) -> Model:
    """Counts over all documents. Nothing but counts of counts comes to the driver."""
    text = docs.select(text_bytes().alias("text"))
    raw = text.mapInArrow(_count, "n int, packed long, c long")
    raw = materialize(raw.groupBy("n", "packed").agg(F.sum("c").alias("c")), "ngrams")
    tables = {ORDER: raw.where(F.col("n") == ORDER).select("packed", "c")}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = materialize(_lower(tables, raw, n), f"order{n}")
    parts, scores, below = [], None, None
    types = tables[1].agg(F.count("*")).first()[0]
    floor = 1.0 / (max(types, 1) + 1)
    for n in range(1, ORDER + 1):
        t = tables[n]
        few = dict(t.where("c <= 4").groupBy("c").count().collect())
        n1, n2, n3, n4 = (few.get(k, 0) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5

        def discount(k, a, b, y=y):
            return min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a and b else 0.5 * k

        d = [discount(1, n1, n2), discount(2, n2, n3), discount(3, n3, n4)]
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        # Arithmetic shift; the mask clears the sign of four-symbol n-grams.
        context = F.shiftright("packed", SYMBOL_BITS).bitwiseAND(F.lit((1 << (SYMBOL_BITS * (n - 1))) - 1 if n > 1 else 0))
        t = t.withColumns({"context": context, "cut": cut})
        totals = t.groupBy("context").agg(F.sum("c").alias("total"), F.sum("cut").alias("kept"))
        both = t.join(totals, "context").withColumns(
            {"value": (F.col("c") - F.col("cut")) / F.col("total"), "weight": F.col("kept") / F.col("total")}
        )
        back = totals.select(F.col("context").alias("packed"), (F.col("kept") / F.col("total")).alias("value"))
        parts.append((both.select("packed", "value"), back))
        if n == 1:
            p = both.withColumn("lower", F.lit(floor))
        else:
            suffix = F.col("packed").bitwiseAND(F.lit((1 << (SYMBOL_BITS * (n - 1))) - 1))
            lower = below.select(F.col("packed").alias("suffix"), F.col("p").alias("lower"))
            p = both.withColumn("suffix", suffix).join(lower, "suffix")
        p = p.select("packed", F.least(F.col("value") + F.col("weight") * F.col("lower"), F.lit(1.0)).alias("p"))
        below = materialize(p, f"p{n}")
        # Shorter n-grams are the greatest of their place only behind a word's start.
        first = F.shiftright("packed", SYMBOL_BITS * (n - 1)) == START
        own = below.where(first) if n < ORDER else below
        own = own.select(F.lit(n).alias("n"), "packed", F.log(F.greatest("p", F.lit(1e-12))).alias("logp"))
        if n > 1:
            scores = own if scores is None else scores.unionByName(own)
    scores = materialize(scores, "scores")
    return Model(scores, scores.count(), parts, floor)


def _arrays(values: DataFrame) -> Arrays:
    t = values.select("packed", "value").toArrow()
    keys, v = t.column(0).to_numpy(), t.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], v[order]


class Judge:
    """Counts of the base rules and perplexity of texts."""

    def __init__(self, known: Known | HotWords):
        self.known = known
        self.table = WordTable(self._describe)

    def _describe(self, words: list[bytes]) -> list[np.ndarray]:
        scores, symbols = self.known.word_scores(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        chars = sums(((raw & 0xC0) != 0x80).astype(np.int64), lengths)
        return [scores, symbols, chars, sums(_IS_SYMBOL[raw], lengths)]

    def read(self, texts: list[bytes]) -> list[np.ndarray]:
        """The base measures of each text, and the score and symbols of its known words."""
        return self._of(texts, [t.split() for t in texts])[0]

    def read_all(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, list[bytes], np.ndarray]:
        """``read``, and each text's distinct other words: their text, they, and how often."""
        split = [t.split() for t in texts]
        out, numbers, counts = self._of(texts, split)
        other = np.flatnonzero(self.table.columns[1][numbers] == 0)
        flat = [w for words in split for w in words] if len(other) else []
        text = np.repeat(np.arange(len(texts)), counts)
        size = int(numbers.max(initial=0)) + 1
        key, at, times = np.unique(text[other] * size + numbers[other], return_index=True, return_counts=True)
        return out, key // size, [flat[i] for i in other[at]], times

    def _of(self, texts: list[bytes], split: list[list[bytes]]):
        numbers, counts = self.table.numbers(split)
        scores, symbols, chars, marks = (sums(c[numbers], counts) for c in self.table.columns)
        out = [
            counts, chars, marks, np.array([duplicate_lines(t) for t in texts], np.int64),
            repeated_words(numbers, counts), scores, symbols,
        ]
        return out, numbers, counts


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def repeated_words(numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    n = len(numbers)
    out = np.zeros(len(counts), np.int64)
    if n < WINDOW:
        return out
    owner = np.repeat(np.arange(len(counts)), counts)
    h = numbers.astype(np.uint64) + np.uint64(1)
    h = (h ^ (h >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    size = n - WINDOW + 1
    w = owner[:size].astype(np.uint64) * _MIX
    for k in range(WINDOW):
        w = w * np.uint64(0x2545F4914F6CDD1D) + h[k : k + size]
    begin = np.flatnonzero(owner[:size] == owner[WINDOW - 1 :])  # whole windows
    w = w[begin]
    order = np.argsort(w, kind="stable")
    equal = w[order][1:] == w[order][:-1]
    twice = np.zeros(len(begin), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    hits = begin[twice]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + WINDOW, -1)
    return np.bincount(owner, np.cumsum(cover[:-1]) > 0, len(counts)).astype(np.int64)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


_COLUMNS = [*[(m, pa.int64()) for m in MEASURES], ("score", pa.float64()), ("symbols", pa.int64())]
_KINDS = ", ".join(f"{m} long" for m in MEASURES) + ", score double, symbols long"


def measures(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang``, a hash ``same`` of the text, the base measures and ``entropy``, in nats a
    symbol, per row of the counted documents."""
    rows = docs.select("doc_id", "lang", text_bytes().alias("text"), *[c.alias(k) for k, c in doc_key().items()])
    rows = rows.withColumn("same", F.xxhash64("text"))
    if model.n_grams <= FITS:
        logs = {}
        for n in range(2, ORDER + 1):
            logs[n] = _arrays(model.scores.where(F.col("n") == n).withColumnRenamed("logp", "value"))
        scored = _measured(rows, Known(logs, float(np.log(model.floor))))
    else:
        scored = _joined(rows, model)
    entropy = -F.col("score") / F.greatest("symbols", F.lit(1))
    return scored.select("doc_id", "lang", "same", *MEASURES, entropy.alias("entropy"))


def _measured(rows: DataFrame, known: Known) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("same", pa.int64()), *_COLUMNS])

    def run(batches):
        judge = Judge(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                own = [part.column(k) for k in ("doc_id", "lang", "same")]
                yield batch_of(schema, *own, *judge.read(part.column("text").to_pylist()))

    return rows.select("doc_id", "lang", "same", "text").mapInArrow(run, f"doc_id long, lang string, same long, {_KINDS}")


def _distinct(batches):
    """Words and how often they occur, counted within the task."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])
    counts: dict[bytes, int] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            for text in part.column("text").to_pylist():
                for word in text.split():
                    counts[word] = counts.get(word, 0) + 1
            if len(counts) > 250_000:
                yield batch_of(schema, list(counts), list(counts.values()))
                counts = {}
    if counts:
        yield batch_of(schema, list(counts), list(counts.values()))


def _spread(batches):
    """One row for each symbol of each word: the word and its greatest n-gram there."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("n", pa.int32()), ("packed", pa.int64())])
    for batch in batches:
        for part in slices(batch, "word", 500_000):
            words = part.column("word").to_pylist()
            if words:
                flat, lengths = units(words)
                order, packed = greatest(flat, lengths)
                at = np.repeat(np.arange(len(words)), lengths - 1)
                yield batch_of(schema, [words[i] for i in at], part.column("c").to_numpy()[at], order, packed)


def _joined(rows: DataFrame, model: Model) -> DataFrame:
    """As ``_measured``, with n-grams, words and documents joined, so nothing need fit."""
    words = rows.select("text").mapInArrow(_distinct, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    each = words.mapInArrow(_spread, "word binary, c long, n int, packed long").join(model.scores, ["n", "packed"])
    scored = each.groupBy("word").agg(F.max("c").alias("c"), F.sum("logp").alias("word_score"), F.count("*").alias("word_symbols"))
    scored = materialize(scored, "words")
    hot = scored.orderBy(F.desc("c"), "word").limit(HOT).select("word", "word_score", "word_symbols").toArrow()
    hot = HotWords(*[hot.column(0).to_pylist(), hot.column(1).to_numpy(), hot.column(2).to_numpy()])
    shared = rows.sparkSession.sparkContext.broadcast(hot)
    keys = [("doc", pa.int64()), ("fp", pa.int64()), ("lang", pa.string()), ("same", pa.int64())]
    schema = pa.schema([*keys, ("doc_id", pa.int64()), ("is_doc", pa.int64()), ("word", pa.binary()), ("times", pa.int64()), *_COLUMNS])

    def run(batches):
        judge = Judge(shared.value)
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                own, text, words, times = judge.read_all(part.column("text").to_pylist())
                key, n = [part.column(k) for k in ("doc", "fp", "lang", "same")], part.num_rows
                # A text's own row joins no word; a space keeps it apart and its hash spreads it.
                tags = [b" %d" % x for x in part.column("fp").to_pylist()]
                yield batch_of(schema, *key, part.column("doc_id"), np.ones(n, np.int64), tags, np.zeros(n, np.int64), *own)
                if words:
                    zero = np.zeros(len(words), np.int64)
                    key = [c.take(pa.array(text)) for c in key]
                    rest = [zero] * len(MEASURES)
                    yield batch_of(schema, *key, [None] * len(words), zero, words, times, *rest, zero.astype(float), zero)

    parts = rows.mapInArrow(run, f"doc long, fp long, lang string, same long, doc_id long, is_doc long, word binary, times long, {_KINDS}")
    parts = parts.join(scored.drop("c"), "word", "left")
    times = F.col("times")
    parts = parts.withColumns(
        {
            "score": F.col("score") + F.coalesce(times * F.col("word_score"), F.lit(0.0)),
            "symbols": F.col("symbols") + F.coalesce(times * F.col("word_symbols"), F.lit(0)),
        }
    )
    # Rows equal in id, text and language gave their parts each, so the sums hold them all.
    whole = [*MEASURES, "symbols"]
    total = parts.groupBy(*KEY, "lang", "same").agg(
        F.max("doc_id").alias("doc_id"), F.sum("is_doc").alias("rows"), *[F.sum(x).alias(x) for x in [*whole, "score"]]
    )
    each = total.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    mean = [F.floor(F.col(x) / F.col("rows") + 0.5).cast("long").alias(x) for x in whole]
    return each.select("doc_id", "lang", "same", *mean, (F.col("score") / F.col("rows")).alias("score"))


def deviation(middle: str) -> Column:
    """Distance of ``entropy`` from the column ``middle``, in units of what the mean over so
    many symbols varies by itself."""
    symbols = F.greatest(F.col("word_chars") + F.col("n_words"), F.lit(1))
    return (F.col("entropy") - F.col(middle)) / F.sqrt(F.lit(OWN_SPREAD**2) + F.lit(SYMBOL_SPREAD**2) / symbols)


def with_bands(rows: DataFrame) -> DataFrame:
    """``rows`` with ``middle``, ``lower`` and ``upper`` of their language: its median entropy, and
    the most that ``deviation`` may be below and above it. Each distinct text counts once."""
    scored = rows.where("n_words > 0").select("lang", "same", "entropy", "word_chars", "n_words")
    once = materialize(scored.dropDuplicates(["lang", "same"]), "once")
    median = F.percentile_approx("entropy", 0.5, 5000)
    general = once.agg(median).first()[0]
    middles = once.groupBy("lang").agg(median.alias("middle"), F.count("*").alias("texts"))
    middles = materialize(middles.where(F.col("texts") >= FEW).drop("texts"), "middles")

    def limits(z: DataFrame, *by: str) -> DataFrame:
        edges = z.groupBy(*by).agg(F.percentile_approx("z", [0.5 - CORE, 0.5, 0.5 + CORE], 5000).alias("q"))

        def limit(k: int) -> Column:
            return F.greatest((F.col("q")[k + 1] - F.col("q")[k]) / CORE_WIDTH * WIDTH, F.lit(LEAST_LIMIT))

        return edges.select(*by, limit(0).alias("lower"), limit(1).alias("upper"))

    own = once.alias("o").join(middles.alias("m"), same("o", "m", ["lang"])).select("o.*", "middle")
    bands = limits(own.withColumn("z", deviation("middle")), "lang")
    bands = bands.alias("b").join(middles.alias("m"), same("b", "m", ["lang"])).select("b.*", "middle")
    bands = materialize(bands, "bands")
    of_all = limits(once.withColumn("middle", F.lit(general or 0.0)).withColumn("z", deviation("middle"))).first()
    lower, upper = (of_all["lower"], of_all["upper"]) if of_all else (LEAST_LIMIT, LEAST_LIMIT)
    otherwise = {"middle": general or 0.0, "lower": lower or LEAST_LIMIT, "upper": upper or LEAST_LIMIT}
    joined = rows.alias("r").join(bands.alias("b"), same("r", "b", ["lang"]), "left")
    return joined.select("r.*", *[F.coalesce(f"b.{k}", F.lit(x)).alias(k) for k, x in otherwise.items()])


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed``, ``perplexity``, ``kept`` per row."""
    rows = materialize(measures(docs, fit(docs)), "measures")
    joined = with_bands(rows)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = ~failed & deviation("middle").between(-F.col("lower"), F.col("upper"))
    return joined.select(
        "doc_id", *MEASURES, failed.alias("base_failed"), F.exp("entropy").alias("perplexity"), kept.alias("kept")
    )
