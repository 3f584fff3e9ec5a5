"""Language-model scores from Brown classes: P(word | previous) = P(class | previous class) P(word | class).

Words are counted over the whole training corpus, by 64-bit hashes. Every word that occurs ``LEAST``
times or more, or is among the ``CLASSED`` most frequent, has a class; how many there are, and how many classes, grows with the corpus. The exchange
has two steps. The most frequent words seed the classes: word by word, one moves to the class that raises
the likelihood of the class bigrams most. Then all others move at once in sweeps over a Spark table of
bigram counts, each to the class that explains its neighbours' classes best, for as long as the
likelihood rises. All other words share one class of rare words.
Transitions and emissions are smoothed, so every text has a probability; a word that was never seen is
one event of the rare class.

Tables that are sent out hold at most ``COUNTED`` words, the most frequent ones. Counts and classes of
words beyond are joined by shuffle, and every count is taken over all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from trafficlens.llm.collocations import _bits as bits_of
from trafficlens.llm.collocations import _frequent as has_bit
from trafficlens.llm.columns import named, shared_table, text_of
from trafficlens.llm.word_arrays import buffer_of, slices, word_spans
from trafficlens.plans.sides import small_side

#: Occurrences that give a word a class, and words that have one however rare they are; words that
#: seed the classes; words sent to all tasks.
LEAST, CLASSED, EXCHANGED, COUNTED = 100, 16_384, 1500, 1 << 18
#: Classes at least, and sweeps of the seeds and of all other words.
CLASSES, SWEEPS, MOVES = 40, 6, 2
#: The end of a text is a token of its own; no word has this hash by construction of the tables.
END = np.uint64(0)
#: Stands for words without a class in the table of bigrams. There the ``COUNTED`` most frequent words
#: go by their rank, from ``RANKED`` on, since small numbers in order take little room in a shuffle;
#: words beyond go by their hash.
OTHER, RANKED = np.uint64(1), 2
#: What is taken from a rare word's count, for words never seen.
DISCOUNT = 0.6
#: Bigrams of a task that are counted together; Spark adds up what is left before it shuffles.
_HELD = 1 << 20


def _chunks(batches: Iterator[pa.RecordBatch], column: int):
    """(batch, first row, rows, row of each token, hash of each token): words, then an end."""
    for batch in batches:
        for lo, texts in slices(batch.column(column)):
            raw, at = buffer_of(texts)
            row, _, _, h = word_spans(raw, at)
            n = len(texts)
            place = np.arange(len(h)) + row
            rows, tokens = np.empty(len(h) + n, np.int64), np.full(len(h) + n, END, np.uint64)
            tokens[place] = h
            size = np.bincount(row, minlength=n) + 1
            rows[:] = np.repeat(np.arange(n), size)
            yield batch, lo, n, rows, tokens


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, _, tokens in _chunks(batches, 0):
        keys, n = np.unique(tokens, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())],
                                         ["word", "n"])


def _numbers(sorted_keys: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The place of each token in the sorted keys, -1 where it is not among them."""
    if not len(sorted_keys):
        return np.full(len(tokens), -1)
    keys, which = np.unique(tokens, return_inverse=True)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)[which]


def _bigrams(sent):
    """Rows (left, right, n) within texts, or (pair, n), left in the high half of ``pair``, if ranks
    are all that is sent; words without a class are ``OTHER``.

    An end stands before each text's first word and after its last. ``sent`` has the hashes of the ranked
    words in order, their ranks, and bits for classed words beyond, if there are any.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, bits = sent.value
        held: list[np.ndarray] = []

        def flush():
            if bits is None:  # two ranks fit into one number, which takes less room in a shuffle
                pairs, n = np.unique(np.concatenate(held), return_counts=True)
                return pa.RecordBatch.from_arrays(
                    [pa.array(pairs.view(np.int64)), pa.array(n, pa.int64())], ["pair", "n"])
            both = np.concatenate(held, axis=1)
            _, first, n = np.unique(both[0] * np.uint64(0x9E3779B97F4A7C15) + both[1],
                                    return_index=True, return_counts=True)
            left, right = both[:, first]
            return pa.RecordBatch.from_arrays(
                [pa.array(left.view(np.int64)), pa.array(right.view(np.int64)),
                 pa.array(n, pa.int64())], ["left", "right", "n"])

        size = 0
        for _, _, _, _, tokens in _chunks(batches, 0):
            at = _numbers(keys, tokens)
            shown = OTHER if bits is None else np.where(has_bit(bits, tokens), tokens, OTHER)
            shown = np.where(tokens == END, END, shown)
            if len(keys):
                shown = np.where(at >= 0, ranks[at], shown)
            # the token before the first one of a text is the end of the text before it
            before = np.concatenate([[END], shown[:-1]])
            held.append(before << np.uint64(32) | shown if bits is None else np.stack([before, shown]))
            size += len(shown)
            if size > _HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes 0 .. classes-1 of words by exchange; ``pairs[v, w]`` says how often w follows v.

    Words are in order of frequency; ``pairs`` has one more row and column for all other words,
    which form a fixed class of their own (number ``classes``).
    """
    words = len(pairs) - 1
    own = np.append(np.arange(words) % classes, classes)
    side = np.zeros((words + 1, classes + 1))
    side[np.arange(words + 1), own] = 1
    after, before = pairs @ side, pairs.T @ side  # word by class of what follows, what precedes
    joint = side.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            a, self_ = own[w], pairs[w, w]
            out, into = after[w].copy(), before[w].copy()
            out[a] -= self_
            into[a] -= self_
            joint[a] -= out
            joint[:, a] -= into
            joint[a, a] -= self_
            lefts, rights = joint.sum(1), joint.sum(0)
            base = _xlogx(joint)
            gain = (_xlogx(joint + out) - base).sum(1) + (_xlogx(joint + into[:, None]) - base).sum(0)
            d = np.arange(classes + 1)
            corner = joint[d, d]
            gain += _xlogx(corner + out + into + self_) + base[d, d] - _xlogx(corner + out) - _xlogx(
                corner + into)
            gain -= _xlogx(lefts + out.sum() + self_) - _xlogx(lefts)
            gain -= _xlogx(rights + into.sum() + self_) - _xlogx(rights)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            joint[b] += out
            joint[:, b] += into
            joint[b, b] += self_
            if b != a:
                moved += 1
                own[w] = b
                for table, line in ((after, pairs[:, w]), (before, pairs[w])):
                    table[:, a] -= line
                    table[:, b] += line
        if moved <= words // 200:
            break
    return own[:words]


@dataclass(frozen=True)
class Brown:
    """``keys`` (in order): the most frequent words, with counts, classes and emissions.

    ``all_classed`` tells whether every word that has a class is among them.
    """

    keys: np.ndarray
    count: np.ndarray
    cls: np.ndarray
    emit: np.ndarray  # log10 P(word | class) of each key
    step: np.ndarray  # log10 P(class | class before)
    end: int
    rare: int
    rare_tokens: float
    rare_types: float
    tokens: int
    types: int
    all_classed: bool


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(keys, np.uint64).view(np.int64))


def _class_of(bigrams: DataFrame, classes: DataFrame, rare: int) -> DataFrame:
    """``bigrams`` with the classes ``cl`` and ``cr`` of both words.

    If ``classes`` has a column ``moves``, so have the results, as ``ml`` and ``mr``.
    """
    moves = "moves" in classes.columns
    classes = small_side(classes)
    for side, cls, move in (("left", "cl", "ml"), ("right", "cr", "mr")):
        own = [F.col("word").alias(side), F.col("cls").alias(cls)]
        bigrams = bigrams.join(
            classes.select(*own, *([F.col("moves").alias(move)] if moves else [])), side, "left"
        ).withColumn(cls, F.coalesce(cls, F.lit(rare)).cast("int"))
    return bigrams


def _joint(classed: DataFrame, rare: int) -> np.ndarray:
    """Class bigrams of the corpus: (classes + 2)**2 sums, which come to the driver."""
    got = classed.groupBy("cl", "cr").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((rare + 1, rare + 1))
    out[got.column(0).to_numpy(), got.column(1).to_numpy()] = got.column(2).to_numpy()
    return out


def _likelihood(joint: np.ndarray) -> float:
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(0)).sum() - _xlogx(joint.sum(1)).sum())


def _best(weights: np.ndarray):
    """(word, cls): the class under which a word's neighbours are likeliest.

    ``seen`` lists (place, n): what follows a word by class, then what precedes it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                seen = part.column(1)
                rows = np.repeat(np.arange(len(part)), pc.list_value_length(seen))
                flat = seen.flatten()
                table = np.zeros((len(part), len(weights)))
                np.add.at(table, (rows, flat.field(0).to_numpy()), flat.field(1).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.argmax(table @ weights, axis=1), pa.int32())],
                    ["word", "cls"])

    return run


def _moved(classed: DataFrame, joint: np.ndarray, end: int) -> DataFrame:
    """(word, cls) of the words that move, each moved to the class that suits it best.

    Rows are dealt by word at once: bigrams are distinct already, so there is little to combine
    before. No such word is hot, since the most frequent ones are seeds and stay.
    """
    after = classed.where("ml").select(
        F.col("left").alias("word"), F.col("cr").alias("place"), "n")
    before = classed.where("mr").select(
        F.col("right").alias("word"), (F.col("cl") + len(joint)).alias("place"), "n")
    seen = after.unionByName(before).repartition("word").groupBy("word", "place").agg(
        F.sum("n").cast("double").alias("n")).groupBy("word").agg(
        F.collect_list(F.struct("place", "n")).alias("seen"))
    held = joint + 0.5
    weights = np.concatenate([np.log(held / held.sum(1, keepdims=True)).T,
                              np.log(held / held.sum(0, keepdims=True))])[:, :end]
    return seen.mapInArrow(_best(weights), "word long, cls int")


def _seeded(bigrams: DataFrame, keys: np.ndarray, classes: int) -> np.ndarray:
    """Classes of the seeds ``keys`` by exchange; ends and all other words are one fixed class."""
    k = len(keys)
    if not k:
        return np.empty(0, np.int64)
    spark = bigrams.sparkSession
    ids = spark.createDataFrame(pa.table(
        {"word": _signed(keys), "cls": pa.array(np.arange(k), pa.int32())}))
    pairs = _joint(_class_of(bigrams, F.broadcast(ids), k), k)
    return exchange(pairs, classes)


def train(texts: DataFrame, text_col: str = "text", classes: int | None = None,
          exchanged: int = EXCHANGED, least: int = LEAST, counted: int = COUNTED,
          moves: int = MOVES, classed: int = CLASSED) -> tuple[Brown, DataFrame]:
    """The model, and the table (word, n, cls, emit) of all words of the training texts.

    Every word with ``least`` occurrences gets a class, and in a small corpus at least the
    ``classed`` most frequent words and the seeds. Unless their number is given, classes grow with the root of the words that have one. Null texts count as
    empty (one end each). Without any text the model knows no word, and every token has
    probability one half.
    """
    spark = texts.sparkSession
    own = texts.select(text_of(text_col).alias("text"))
    vocabulary = shared_table(
        own.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")),
        "brown-counts")
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = vocabulary.where(F.col("word") != int(END))
    ranked = words.orderBy(F.desc("n"), "word").limit(max(exchanged, classed))
    floor = min(least, ranked.agg(F.coalesce(F.min("n"), F.lit(least))).first()[0])
    frequent = words.where(F.col("n") >= floor)
    many = frequent.count()
    if classes is None:
        classes = max(CLASSES, math.ceil(math.sqrt(many) / 4))
    # the end is a class of its own, number `classes`; the rare words' class is the one after
    end, rare = classes, classes + 1
    top = frequent.orderBy(F.desc("n"), "word").limit(max(exchanged, counted)).select("word").toArrow()
    hashes = top.column(0).to_numpy().view(np.uint64)
    ranks = np.arange(RANKED, RANKED + len(hashes), dtype=np.uint64)
    seeds, names = ranks[:exchanged], spark.createDataFrame(pa.table(
        {"word": _signed(ranks), "hash": _signed(hashes)}))
    beyond = None
    if many > len(hashes):
        ranked_ = F.broadcast(names.select(F.col("hash").alias("word")))
        beyond = frequent.join(ranked_, "word", "left_anti").select("word")
    by_hash = np.argsort(hashes)
    sent = spark.sparkContext.broadcast((
        hashes[by_hash], ranks[by_hash],
        None if beyond is None else bits_of(beyond.select(F.col("word").alias("key")))))
    found = own.mapInArrow(
        _bigrams(sent), "pair long, n long" if beyond is None else "left long, right long, n long")
    if beyond is None:
        counted_ = found.groupBy("pair").agg(F.sum("n").alias("n")).select(
            F.shiftrightunsigned("pair", 32).alias("left"),
            F.col("pair").bitwiseAND(0xFFFFFFFF).alias("right"), "n")
    else:
        counted_ = found.groupBy("left", "right").agg(F.sum("n").alias("n"))
    # in order, rows of a word are alike and take less room in the shuffles of every sweep
    bigrams = shared_table(counted_.sortWithinPartitions("left"), "brown-bigrams")
    fixed = spark.createDataFrame(pa.table({
        "word": _signed(np.append(seeds, END)),
        "cls": pa.array(np.append(_seeded(bigrams, seeds, classes), end), pa.int32())}))
    # all but the seeds begin as rare words
    stay = F.lit(False).alias("moves")
    others = spark.range(RANKED + len(seeds), RANKED + len(ranks)).select(F.col("id").alias("word"))
    others = (others if beyond is None else others.unionByName(beyond)).select(
        "word", F.lit(rare).alias("cls"), F.lit(True).alias("moves"))
    chosen = shared_table(fixed.select("*", stay).unionByName(others), "brown-classes")
    classed_ = _class_of(bigrams, chosen, rare)
    joint = _joint(classed_, rare)
    if many > len(seeds):
        for move in range(moves):
            after = shared_table(fixed.select("*", stay).unionByName(
                _moved(classed_, joint, end).withColumn("moves", F.lit(True))), "brown-classes")
            classed_ = _class_of(bigrams, after, rare)
            next_ = _joint(classed_, rare)
            gain = _likelihood(next_) - _likelihood(joint)
            if move and gain <= 0:
                break
            chosen, joint = after, next_
            if move and gain <= 1e-3 * abs(_likelihood(joint)):
                break
    mass = joint.sum(0)
    usable = (mass > 0) | (np.arange(rare + 1) >= end)
    single = np.where(usable, mass + 0.5, 0.0)
    single /= single.sum()
    with np.errstate(divide="ignore"):
        step = np.maximum(np.log10((joint + 2.0 * single) / (joint.sum(1, keepdims=True) + 2.0)),
                          -30.0)
    rare_tokens = float(mass[rare])
    rare_types = float(total[1] - many - (mass[end] > 0))
    masses = spark.createDataFrame(pa.table({
        "cls": pa.array(np.arange(rare + 1), pa.int32()), "mass": pa.array(mass)}))
    emit = F.when(F.col("cls") == rare, _rare(F.col("n"), rare_tokens)).otherwise(
        F.log10(F.col("n") / F.col("mass")))
    named_ = chosen.join(F.broadcast(names), "word", "left").select(
        F.coalesce("hash", "word").alias("word"), "cls")
    table = shared_table(
        vocabulary.join(small_side(named_), "word", "left")
        .withColumn("cls", F.coalesce("cls", F.lit(rare)).cast("int"))
        .join(F.broadcast(masses), "cls")
        .select("word", "n", "cls", emit.alias("emit")), "brown-words")
    model = table.where(F.col("word") != int(END)).orderBy(F.desc("n"), "word").limit(
        counted).unionByName(table.where(F.col("word") == int(END))).toArrow()
    got = [model.column(i).to_numpy() for i in range(4)]
    if not total[0]:
        got = [np.append(x, y) for x, y in zip(got, (0, 0, end, 0.0))]
    known = got[0].astype(np.int64).view(np.uint64)
    order = np.argsort(known)
    return Brown(known[order], got[1][order], got[2][order].astype(np.int64), got[3][order], step,
                 end, rare, rare_tokens, rare_types, int(total[0]), int(total[1]),
                 many <= counted), table


def _rare(n: Column, tokens: float) -> Column:
    """log10 P(word | rare class) of a word seen n times."""
    return F.log10(F.greatest(n - DISCOUNT, F.lit(0.1)) / (tokens + 1.0))


def _unseen(model: Brown) -> float:
    """log10 of the probability, in the rare class, of all words never seen."""
    return math.log10((DISCOUNT * model.rare_types + 1.0) / (model.rare_tokens + 1.0))


def _lists(rows: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    cut = np.searchsorted(rows, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values.view(np.int64)))


def _score(sent, unit: float):
    """Scores from the words sent; ``tail`` lists the others, each once and how many ``times`` it
    comes, ``left`` and ``right`` the steps to or from those, unless such words are known to be rare."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = SimpleNamespace(**sent.value)
        base = np.log10((m.count + 1) / unit)
        for batch, lo, n, rows, tokens in _chunks(batches, 2):
            at = _numbers(m.keys, tokens)
            known = at >= 0
            cls = np.where(known, m.cls[at], m.rare)
            before = np.concatenate([[m.end], cls[:-1]])
            step = m.step[before, cls]
            far = np.flatnonzero(~known)
            open_ = np.empty(0, np.int64)
            if not m.all_classed:
                sure = known & np.concatenate([[True], known[:-1]])
                step, open_ = np.where(sure, step, 0.0), np.flatnonzero(~sure)
            score = step + np.where(known, m.emit[at], 0.0)
            order = far[np.lexsort((tokens[far], rows[far]))]
            r, w = rows[order], tokens[order]
            new = np.ones(len(order), bool)
            new[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
            first = np.flatnonzero(new)
            times, far = np.diff(first, append=len(order)), order[first]
            part = batch.slice(lo, n)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1),
                 pa.array(np.bincount(rows, minlength=n), pa.int64()),
                 pa.array(np.bincount(rows, known & (m.count[at] > 0), n).astype(np.int64)),
                 pa.array(np.bincount(rows, np.where(known, base[at], 0.0), n)),
                 pa.array(np.bincount(rows, score, n)),
                 _lists(rows[far], n, tokens[far]), _lists(rows[far], n, times),
                 _lists(rows[open_], n, np.concatenate([[END], tokens[:-1]])[open_]),
                 _lists(rows[open_], n, tokens[open_])],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail",
                 "times", "left", "right"])

    return run


def _open_steps(near: DataFrame, model: Brown, words: DataFrame) -> DataFrame:
    """(row, far_score): the steps to or from words whose classes were not sent."""
    pairs = near.select("row", F.explode(F.arrays_zip("left", "right")).alias("p")).groupBy(
        "row", F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(
        F.count("*").alias("n"))
    size = model.rare + 1
    steps = near.sparkSession.createDataFrame(pa.table({
        "cl": pa.array(np.repeat(np.arange(size), size), pa.int32()),
        "cr": pa.array(np.tile(np.arange(size), size), pa.int32()),
        "step": pa.array(model.step.reshape(-1))}))
    return _class_of(pairs, words, model.rare).join(small_side(steps), ["cl", "cr"]).groupBy(
        "row").agg(F.sum(F.col("n") * F.col("step")).alias("far_score"))


def score(docs: DataFrame, model: Brown, words: DataFrame, held_out, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the add-one unigram score, ``score`` that of the classes, both log10. A null
    or wordless text consists of its end alone. Repeated rows and null ids are scored like others.
    """
    unit = float(model.tokens + model.types + 1)
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    rows = docs.select(named(id_col).alias("doc_id"), held_out.alias("held_out"),
                       text_of(text_col).alias("text"))
    schema = rows.drop("text").schema.add("n_tokens", "long").add("n_known", "long").add(
        "base_score", "double").add("score", "double")
    for name in ("tail", "times", "left", "right"):
        schema = schema.add(name, ArrayType(LongType()))
    near = shared_table(
        rows.mapInArrow(_score(sent, unit), schema)
        .withColumn("row", F.monotonically_increasing_id()), "brown-near")
    tail = near.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select(
        "row", F.col("t.tail").alias("word"), "t.times")
    n = F.coalesce("n", F.lit(0))
    emit = F.coalesce("emit", F.lit(_unseen(model)))
    far = (
        tail.join(words.drop("cls"), "word", "left").groupBy("row")
        .agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("far_known"),
             F.sum(F.col("times") * F.log10((n + 1) / unit)).alias("far_base"),
             F.sum(F.col("times") * emit).alias("far_score"))
    )
    if not model.all_classed:
        far = far.unionByName(_open_steps(near, model, words), allowMissingColumns=True).groupBy(
            "row").agg(*[F.sum(c).alias(c) for c in ("far_known", "far_base", "far_score")])
    plus = {"n_known": "far_known", "base_score": "far_base", "score": "far_score"}
    joined = near.drop("tail", "times", "left", "right").join(far, "row", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("far_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        *[(F.col(k) + F.coalesce(v, F.lit(0.0))).alias(k) for k, v in plus.items()
          if k != "n_known"])
