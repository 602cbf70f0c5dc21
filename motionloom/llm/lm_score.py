"""Log-likelihood of whole documents under a gated recurrent language model and a unigram base.

Method: a GRU over words, trained by truncated backpropagation in numpy, with a class-factored output:
P(word) = P(class | state) * P(word | class, state). The most frequent words have classes of their
own with learned outputs; rarer ones fall into frequency bands, whose class is learned and whose
words share it by their counts. State is carried from window to window, from a document's first
token to its end token, so that a score is the log-likelihood of the complete text.

On Spark: counts of all training tokens are summed by word and stay a distributed table. Words above a
count that at most `HEAD` words reach go to every task; all other words of a document are joined with
the counts by shuffle, in both scores alike. Every text is turned into symbols once, two bytes a
token, in a checkpointed table that training and scoring read. Training is data-parallel: in each of
`ROUNDS` rounds every partition trains the current weights on its own part of a share of the training
documents (one in ROUNDS, by a hash of the id, another share each round, so that all have been trained
on), and the results are averaged by Spark block by block, in two levels. The work and what is gathered
grow with the corpus, the weights do not.

Both scores share one event space: the distinct training tokens and one symbol for all others.

Edge cases: a null or empty text is the end token alone; repeated rows are scored, and counted, as
rows of their own; a null id counts as an empty one in the fold; words of one count are all in the head
or none is; a very long text is scored whole, window by window; without training documents every count
is zero and classes keep their initial weights; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ASCII_LOWER, cut, fold, ready, release

END = "\n"  # no word holds one
HEAD = 1 << 18
CLASSES, CLASS_WORDS = 64, 64
OWN = CLASSES * CLASS_WORDS
#: Where the bands of rarer head words end; words beyond the head are a band of their own.
BANDS = (1 << 14, HEAD)
SYMBOLS = OWN + len(BANDS) + 1
EMBED, HIDDEN, WINDOW = 24, 32, 32
STREAMS = 256
#: Texts of like length that are scored side by side.
LANES = 512
#: Rows of states whose outputs are worked out at a time, so that they stay in a core's cache.
ROWS = 8192
#: Rows of one step of that: their logits, shares and errors are worked out one after the other.
CACHED_ROWS = 1024
#: Each round takes another share of the training documents; all rounds together take all.
ROUNDS = SHARE = 2
RATE = 0.15
BLOCK = 4096
#: Groups into which the weights of partitions are averaged first.
PARTS = 256
#: Tokens that a task holds at a time, two bytes each, to train on and to score; many texts side by side keep steps full.
GROUP_TOKENS, SCORE_TOKENS = 1 << 19, 1 << 22
#: Bytes of words that a task counts, and looks up, at a time: some two million and 800,000 words of prose.
COUNT_BYTES, LOOK_UP_BYTES = 3 << 23, 1 << 23


def tokens(text: str) -> list[bytes]:
    return text.encode().translate(ASCII_LOWER).split()


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The `tokens` of all texts of an Arrow column, one after the other, and how many each text has."""
    told = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat = told.flatten()
    full = pc.greater(pc.binary_length(flat), 0)  # blanks at a text's ends leave empty ones
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return flat.filter(full), np.diff(before[told.offsets.to_numpy() - told.offsets[0].as_py()])


def token_counts(docs: DataFrame) -> DataFrame:
    """word, c over all rows of docs (text); the end token is END."""

    def rows(held, ends):
        told = pa.chunked_array(held, pa.string()).value_counts()
        for words, c in ((told.field(0), told.field(1)), (pa.array([END]), pa.array([ends], pa.int64()))):
            yield pa.RecordBatch.from_arrays([words, c], ["word", "c"])

    def each(batches):
        held, size, ends = [], 0, 0
        for batch in batches:
            held.append(words_of(batch.column(0))[0])
            size, ends = size + held[-1].nbytes, ends + batch.num_rows
            if size > COUNT_BYTES:
                yield from rows(held, ends)
                held, size, ends = [], 0, 0
        if ends:
            yield from rows(held, ends)

    return docs.select("text").mapInArrow(each, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Words:
    """The head of the vocabulary: END first, then words by falling count. Everything a task needs to look words up."""

    def __init__(self, words: list[str], counts: list[int], total: int, distinct: int):
        self.words, self.total, self.distinct = words, total, distinct
        self.counts = np.array(counts, np.float64)

    def base_logs(self) -> np.ndarray:
        """log10 of the smoothed share of each head word."""
        return np.log10((self.counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def symbols(self) -> np.ndarray:
        """The model's symbol of each head word."""
        rank = np.arange(len(self.words))
        return np.where(rank < OWN, rank, OWN + np.searchsorted(BANDS, rank, side="right"))

    def band_logs(self) -> np.ndarray:
        """log10 of a word's share of its band; 0 for words with an output of their own."""
        found, start = np.zeros(len(self.words)), OWN
        for end in BANDS:
            part = self.counts[start:end] + 0.1
            found[start:end] = np.log10(part / part.sum()) if len(part) else 0
            start = end
        return found

    def tail_mass(self) -> float:
        """Smoothed count of all words beyond the head, those never seen as one of them."""
        return self.total - self.counts.sum() + 0.1 * (self.distinct - int((self.counts > 0).sum()) + 1)


class Gru:
    """Weights by name, and what is done with them. Symbol 0 is the end token; it is also the first input of a text."""

    SHAPES = {
        "embed": (SYMBOLS, EMBED), "enter": (EMBED, 3 * HIDDEN), "enter_bias": (1, 3 * HIDDEN), "gates": (HIDDEN, 2 * HIDDEN),
        "candidate": (HIDDEN, HIDDEN), "classes": (HIDDEN, CLASSES + len(BANDS) + 1), "class_bias": (1, CLASSES + len(BANDS) + 1),
        "words": (OWN, HIDDEN), "word_bias": (OWN, 1),
    }

    def __init__(self, own_words: int = OWN):
        rng = np.random.default_rng(3)
        self.w = {k: (rng.standard_normal(s) * (0.0 if "bias" in k else 0.1)).astype(np.float32) for k, s in self.SHAPES.items()}
        self.w["word_bias"][own_words:] = -30  # symbols that no word has

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.SHAPES])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for k, s in self.SHAPES.items():
            size = s[0] * s[1]
            self.w[k] = flat[at : at + size].reshape(s).astype(np.float32)
            at += size
        return self

    @staticmethod
    def class_of(symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < OWN, symbols // CLASS_WORDS, symbols - OWN + CLASSES)

    @staticmethod
    def logs(logits: np.ndarray, at: np.ndarray, learn: bool) -> np.ndarray:
        """Natural log of each row's share at `at`. With learn, logits become shares, less one at `at`; else they are used up."""
        if logits.size and logits.max() > 60:  # only large ones cannot be raised to the power as they are
            logits -= logits.max(axis=1, keepdims=True)
        n = np.arange(len(at))
        told = logits[n, at]
        np.exp(logits, out=logits)
        sums = logits @ np.ones(logits.shape[1], np.float32)
        if learn:
            logits *= np.reciprocal(sums)[:, None]
            logits[n, at] -= 1
        return told - np.log(sums)

    def output(self, states: np.ndarray, targets: np.ndarray, learn: bool = False):
        """Natural log P(target | state), without shares in bands. With learn, also gradients of their negative sum."""
        w, kind = self.w, self.class_of(targets).astype(np.uint8)
        states = np.ascontiguousarray(states)  # rows are taken from it, block by block
        order = np.argsort(kind, kind="stable")  # rows of one class stand together
        kind = kind[order].astype(np.int64)
        at = targets[order] - kind * CLASS_WORDS
        edges = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
        # biases are weights of a state that is always one
        classes, words = np.vstack((w["classes"], w["class_bias"])), np.hstack((w["words"], w["word_bias"]))
        back_classes, back_words = np.ascontiguousarray(w["classes"].T), w["words"]
        own = np.ones((CACHED_ROWS, HIDDEN + 1), np.float32)
        shares, inner = np.empty((CACHED_ROWS, classes.shape[1]), np.float32), np.empty((CACHED_ROWS, CLASS_WORDS), np.float32)
        found = np.empty(len(order), np.float32)
        if learn:
            back, by_class, by_word = np.empty((len(order), HIDDEN), np.float32), np.zeros_like(classes), np.zeros_like(words)
        for start in range(0, len(order), CACHED_ROWS):
            rows = order[start : start + CACHED_ROWS]
            n, worded = len(rows), min(len(rows), max(0, edges[-1] - start))  # bands have no words
            x, p, q = own[:n], shares[:n], inner[:worded]
            x[:, :HIDDEN] = states.take(rows, axis=0)
            np.matmul(x, classes, out=p)
            logp = self.logs(p, kind[start : start + n], learn)
            parts = []
            for c in range(int(kind[start]), int(kind[start + worded - 1]) + 1 if worded else 0):
                first, last = max(edges[c] - start, 0), min(edges[c + 1] - start, n)
                if first < last:
                    parts.append((slice(first, last), slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)))
            for mine, part in parts:
                np.matmul(x[mine], words[part].T, out=q[mine])
            logp[:worded] += self.logs(q, at[start : start + worded], learn)
            found[rows] = logp
            if learn:
                by_class += x.T @ p
                error = p @ back_classes
                for mine, part in parts:
                    error[mine] += q[mine] @ back_words[part]
                    by_word[part] += q[mine].T @ x[mine]
                back[rows] = error
        if not learn:
            return found
        return found, back, {"classes": by_class[:HIDDEN], "class_bias": by_class[HIDDEN:], "words": np.ascontiguousarray(by_word[:, :HIDDEN]), "word_bias": by_word[:, HIDDEN:]}

    def inputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each symbol's embedding with a one behind it, and the way into the gates with the bias as the last row."""
        return np.hstack((self.w["embed"], np.ones((SYMBOLS, 1), np.float32))), np.vstack((self.w["enter"], self.w["enter_bias"]))

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each text, given as symbols that end with 0; without shares in bands.

        LANES texts of like length go side by side, so that their states stay in a core's cache."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat, starts = np.concatenate([*texts, np.zeros(1, np.uint16)]), np.cumsum(lengths) - lengths
        embed, enter = self.inputs()
        gates, candidate = self.w["gates"], self.w["candidate"]
        total = np.zeros(len(texts))
        states, targets, owners, held = [], [], [], 0

        def work_out():
            logp = self.output(np.concatenate(states), np.concatenate(targets))
            total[:] += np.bincount(np.concatenate(owners), weights=logp, minlength=len(texts))
            states.clear(), targets.clear(), owners.clear()

        for lane in range(0, len(texts), LANES):
            own = order[lane : lane + LANES]
            at, longest_first = starts[own], -lengths[own]
            state, last = np.zeros((HIDDEN, len(own)), np.float32).T, np.zeros(len(own), np.int64)
            for start in range(0, -int(longest_first[0]), WINDOW):
                live = np.searchsorted(longest_first, -np.arange(start, start + WINDOW)).tolist()  # texts with a symbol there
                ids = flat[np.minimum(at[: live[0]] + np.arange(start, start + WINDOW)[:, None], len(flat) - 1)].astype(np.int64)
                for t, k in enumerate(live):
                    if not k:
                        break
                    state = self.step((enter.T @ embed.take(last[:k], axis=0).T).T, state[:k], gates, candidate)[0]
                    last = ids[t, :k]
                    states.append(state)
                    targets.append(last)
                    owners.append(own[:k])
                    held += k
                    if held > ROWS:
                        work_out()
                        held = 0
        if states:
            work_out()
        return total

    @staticmethod
    def step(entered, state, gates, candidate):
        """The states after one symbol and what they come from. A row is a text; work is done on columns, which learn and
        scores hold contiguous."""
        entered, state = entered.T, state.T
        with np.errstate(over="ignore"):  # a gate of 0, a state of -1
            zr = gates.T @ state
            zr += entered[: 2 * HIDDEN]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            inner = candidate.T @ state
            new = r * inner
            new += entered[2 * HIDDEN :]
            new *= 2  # tanh(x) = 1 - 2 / (exp(2 x) + 1)
            np.exp(new, out=new)
            new += 1
            np.divide(-2, new, out=new)
            new += 1
        out = state - new
        out *= z
        out += new
        return out.T, z.T, r.T, inner.T, new.T

    def learn(self, symbols: np.ndarray, rate: float = RATE) -> int:
        """One pass over a stream of texts by truncated backpropagation; returns the tokens learned from.

        All tokens are learned from: few go into fewer streams, and what lacks of the last is filled up with the first."""
        streams = min(STREAMS, max(1, len(symbols) // WINDOW))
        steps = -(-len(symbols) // streams)
        stream = np.ascontiguousarray(np.resize(symbols, steps * streams).reshape(streams, steps).T).astype(np.int64)
        inputs = np.concatenate((np.zeros((1, streams), np.int64), stream[:-1]))
        w, squares = self.w, {k: np.full(s, 1e-4, np.float32) for k, s in self.SHAPES.items()}
        state = np.zeros((HIDDEN, streams), np.float32)
        errors, spare, other = np.empty((4 * HIDDEN, streams), np.float32), *np.empty((2, HIDDEN, streams), np.float32)
        d_inner, d_z, d_r, d_new = errors.reshape(4, HIDDEN, streams)

        def adapt(values, sums, g, scale):
            g *= scale
            np.clip(g, -1, 1, out=g)
            again = g * g
            sums += again
            g /= np.sqrt(sums, out=again)
            g *= rate
            values -= g

        for start in range(0, steps, WINDOW):
            x, y = inputs[start : start + WINDOW], stream[start : start + WINDOW]
            size, scale = len(x), 16 / y.size
            embed, enter = self.inputs()
            embedded = embed.take(x, axis=0)
            alive = (x != 0).astype(np.float32)  # a text starts without state
            passed, states = [], np.empty((size, HIDDEN, streams), np.float32)
            for t in range(size):
                before = state * alive[t]
                found = self.step((enter.T @ embedded[t].T).T, before.T, w["gates"], w["candidate"])
                state, *parts = (a.T for a in found)
                passed.append((before, *parts))
                states[t] = state
            _, back, grads = self.output(states.transpose(0, 2, 1).reshape(-1, HIDDEN), y.ravel(), learn=True)
            back = np.ascontiguousarray(back.reshape(size, streams, HIDDEN).transpose(0, 2, 1))
            recur = np.hstack((w["candidate"], w["gates"]))
            by_recur, by_enter = np.zeros((HIDDEN, 3 * HIDDEN), np.float32), np.zeros((3 * HIDDEN, EMBED + 1), np.float32)
            by_input = np.empty((size, streams, EMBED), np.float32)
            carried = np.zeros((HIDDEN, streams), np.float32)
            for t in range(size - 1, -1, -1):
                before, z, r, inner, new = passed[t]
                carried += back[t]
                np.subtract(1, z, out=spare)
                np.multiply(carried, spare, out=d_new)
                spare *= z
                np.subtract(before, new, out=d_z)
                d_z *= spare
                d_z *= carried
                np.multiply(new, new, out=other)
                np.subtract(1, other, out=other)
                d_new *= other
                np.multiply(d_new, r, out=d_inner)
                np.multiply(d_inner, inner, out=d_r)
                np.subtract(1, r, out=spare)
                d_r *= spare
                carried *= z
                carried += recur @ errors[: 3 * HIDDEN]
                carried *= alive[t]
                by_recur += before @ errors[: 3 * HIDDEN].T
                by_enter += errors[HIDDEN:] @ embedded[t]
                np.matmul(errors[HIDDEN:].T, w["enter"].T, out=by_input[t])
            grads["candidate"], grads["gates"] = by_recur[:, :HIDDEN], by_recur[:, HIDDEN:]
            grads["enter"], grads["enter_bias"] = by_enter[:, :EMBED].T, by_enter[:, EMBED:].T
            order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
            ranked = x.ravel()[order]
            first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            seen = ranked[first]
            kept, sums = w["embed"][seen], squares["embed"][seen]
            adapt(kept, sums, np.add.reduceat(by_input.reshape(-1, EMBED).take(order, axis=0), first, axis=0), scale)
            w["embed"][seen], squares["embed"][seen] = kept, sums
            for k, g in grads.items():
                adapt(w[k], squares[k], g, scale)
        return len(symbols)


def vocabulary(counts: DataFrame) -> Words:
    """The head of a table of token counts: all words above the lowest count that HEAD - 1 words at most are above."""
    row = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    words = counts.where(F.col("word") != END)
    step = F.floor(16 * F.log2("c"))  # some thousand of them for any counts
    steps = words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    least, room = None, HEAD - 1
    for level in steps:
        room -= level["n"]
        if room < 0:
            break
        least = level["step"]
    head = words.where(step >= least).select("word", "c").collect() if least is not None else []
    head.sort(key=lambda r: (-r["c"], r["word"]))
    end = counts.where(F.col("word") == END).collect()
    return Words([END, *(r["word"] for r in head)], [end[0]["c"] if end else 0, *(r["c"] for r in head)], row["n"] or 0, row["v"])


def coded(docs: DataFrame, words: Words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base, band (log10 of the words' shares of their bands), symbols (two bytes a token) and
    rare (words beyond the head, with their numbers) of every row of docs."""
    spark = ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast(words)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_tokens", "n_known", "base", "band", "symbols", "rare"]
    schema = f"doc_id {kind}, n_tokens long, n_known long, base double, band double, symbols binary, rare array<struct<word:string,tf:long>>"

    def each(batches):
        head = sent.value
        known, of_head = pa.array(head.words, pa.string()), np.append(head.symbols(), SYMBOLS - 1).astype("<u2")  # the last: beyond the head
        sums = [np.append(column, 0) for column in (head.counts > 0, head.base_logs(), head.band_logs())]

        def rows(held):
            ids, words, sizes = zip(*held, strict=True)
            words, sizes = pa.chunked_array(words, pa.string()).combine_chunks(), np.concatenate(sizes)
            ends = np.cumsum(sizes + 1)
            own, at = np.repeat(np.arange(len(sizes)), sizes), np.zeros(ends[-1], np.int64)  # each text ends with END
            found = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
            at[np.arange(len(own)) + own] = found
            n_known, base, band = (np.add.reduceat(column[at], ends - sizes - 1) for column in sums)
            beyond = found < 0
            told = words.filter(pa.array(beyond)).dictionary_encode()
            kinds = max(1, len(told.dictionary))
            key, tf = np.unique(own[beyond] * kinds + told.indices.to_numpy(), return_counts=True)
            rare = pa.StructArray.from_arrays([told.dictionary.take(pa.array(key % kinds)), pa.array(tf, pa.int64())], ["word", "tf"])
            of_text = pa.array(np.searchsorted(key, np.arange(len(sizes) + 1) * kinds), pa.int32())
            places = pa.array(np.concatenate(([0], 2 * ends)), pa.int32()).buffers()[1]
            symbols = pa.Array.from_buffers(pa.binary(), len(sizes), [None, places, pa.py_buffer(of_head[at].tobytes())])
            numbers = [pa.array(sizes + 1, pa.int64()), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(band)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *numbers, symbols, pa.ListArray.from_arrays(of_text, rare)], names)

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0), *words_of(batch.column(1))))
                size += held[-1][1].nbytes
            if size > LOOK_UP_BYTES:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)
        known = sums = None
        release()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)


def _symbols(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(s.as_py(), "<u2") for s in column]


def train(texts: DataFrame, own_words: int) -> Gru:
    """Averaged weights after ROUNDS rounds over shares of `coded` texts. own_words: words of the head."""
    spark = texts.sparkSession
    model = Gru(min(OWN, own_words))
    drawn = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SHARE))
    schema = "block int, part int, tokens long, weights binary"
    for round_ in range(ROUNDS):
        now = spark.sparkContext.broadcast(model.flat())

        def each(batches, now=now):
            own, held, size, learned, part = Gru().load(now.value), [], 0, 0, TaskContext.get().partitionId()
            for batch in batches:
                held += _symbols(batch.column(0))
                size += sum(map(len, held[-batch.num_rows :])) if batch.num_rows else 0
                if size > GROUP_TOKENS:
                    learned += own.learn(np.concatenate(held))
                    held, size = [], 0
            learned += own.learn(np.concatenate(held)) if held else 0
            if learned:
                flat = own.flat()
                blocks = [flat[at : at + BLOCK].tobytes() for at in range(0, len(flat), BLOCK)]
                numbers = [pa.array([n] * len(blocks), t) for n, t in ((part % PARTS, pa.int32()), (learned, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), *numbers, pa.array(blocks, pa.binary())], ["block", "part", "tokens", "weights"])

        def mean(rows: pd.DataFrame) -> pd.DataFrame:
            share = rows["tokens"].to_numpy(np.float64) / rows["tokens"].sum()
            total = sum(s * np.frombuffer(w, np.float32) for s, w in zip(share, rows["weights"], strict=True))
            return pd.DataFrame({"block": rows["block"].iloc[:1], "part": [0], "tokens": [rows["tokens"].sum()], "weights": [total.astype(np.float32).tobytes()]})

        trained = texts.where(drawn == round_).select("symbols").mapInArrow(each, schema)
        in_parts = trained.groupBy("block", "part").applyInPandas(mean, schema)  # so that no group holds a row of every partition
        blocks = in_parts.groupBy("block").applyInPandas(mean, schema).select("block", "weights").collect()
        if blocks:
            model.load(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(blocks, key=lambda r: r["block"])]))
    return model


def score(texts: DataFrame, counts: DataFrame, words: Words, model: Gru) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10) of every row of a checkpointed table of `coded` texts."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(model.flat())
    texts = texts.withColumn("row", F.monotonically_increasing_id())
    kept = ["doc_id", "row", "n_tokens", "n_known", "base"]
    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept) + ", model double"

    def each(batches):
        gru = Gru().load(sent.value)

        def rows(held):
            logs = gru.scores([t for b in held for t in _symbols(b.column(len(kept) + 1))]) / np.log(10)
            band = np.concatenate([b.column(len(kept)).to_numpy() for b in held])
            columns = [pa.concat_arrays([b.column(i) for b in held]) for i in range(len(kept))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(logs + band)], [*kept, "model"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(len(kept) + 1).nbytes // 2
            if size > SCORE_TOKENS:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    scored = texts.select(*kept, "band", "symbols").mapInArrow(each, schema)
    each_rare = texts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf")
    told = each_rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log_share = lambda whole: F.sum(F.col("tf") * F.log10((F.col("c") + 0.1) / F.lit(float(whole))))
    of_row = told.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("rare_known"),
        log_share(words.total + 0.1 * (words.distinct + 1)).alias("rare_base"),
        log_share(words.tail_mass()).alias("rare_model"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return scored.join(of_row, "row", "left").select(
        "doc_id", "n_tokens", plus("n_known", "rare_known").alias("n_known"),
        plus("base", "rare_base").alias("base_score"), plus("model", "rare_model").alias("score"),
    )


def op9_scores(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    ready(docs.sparkSession)
    counts = cut(token_counts(docs.where(fold(F.col("doc_id"), 10) != 0)))
    words = vocabulary(counts)
    texts = cut(coded(docs, words))
    model = train(texts.where(fold(F.col("doc_id"), 10) != 0), len(words.words))
    return score(texts, counts, words, model).select(
        "doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score",
    )
