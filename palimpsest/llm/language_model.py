"""LM scoring: a gated recurrent language model with a class-factored softmax, trained and applied in numpy in tasks.

Word counts of all training texts are gathered by Spark. The most frequent words (VOCABULARY of them, the end mark
included) are the model's own; they are dealt to classes of equal size by rank. All other words belong to classes
by their last two characters (TAILS of them, and one for the rest). The model gives P(own class or other | history),
P(word | class, history) for its own words and P(tail class | other, history); within a tail class words have
add-one unigram shares.

Training covers every training text once, in two rounds: each task trains a replica from the round's common start
by truncated backpropagation over windows of STEPS words in LANES texts side by side (of more, up to LONGEST_WINDOW,
where fewer texts are left); replicas are averaged, weighted by their words, in a tree of groups of FAN. A round has
no more replicas than give each REPLICA_WORDS words (or FEW_REPLICAS), so that averaging many that learnt little does not cost the gain. In training and scoring the state is carried across windows, so a
text has its whole likelihood. Counts of words beyond the HOT most frequent come by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, split_words, stored, table, text_chunks

VOCABULARY = 2048
CLASS_WORDS = 32
TAILS = 63
HIDDEN = 24
STEPS = 8
LANES = 512
SCORE_LANES = 1024
LONGEST_WINDOW = 256
TEXT_BYTES = 7 << 20
HOT = 1 << 18
MERGE = 1_500_000
FAN = 16
RATE = 0.08
BLOCK = 1024
FIRST_ROUND = 8
REPLICA_WORDS, FEW_REPLICAS = 400_000, 4  # a replica sees so many words at least, unless replicas are few, whose mean is steadier than one
LARGE = 60.0
END = "\n"  # never part of a word

OWN = VOCABULARY // CLASS_WORDS
CLASSES = OWN + TAILS + 1
INPUTS = VOCABULARY + TAILS + 1


def _with_one(h: np.ndarray) -> np.ndarray:
    """h with a column of ones, so that a bias is one more row of weights."""
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    return out


def _exponents(logits: np.ndarray, aims: np.ndarray, far: bool) -> tuple[np.ndarray, np.ndarray]:
    """The aims' logits and the sums of all exponentials, which take the logits' place; beyond LARGE a logit counts as LARGE."""
    if far:
        np.minimum(logits, LARGE, out=logits)
    aim = np.take(logits.ravel(), np.arange(len(logits)) * logits.shape[1] + aims)
    np.exp(logits, out=logits)
    return aim, logits @ np.ones(logits.shape[1], logits.dtype)


class Model:
    """A GRU over words and classes. Inputs are rows of gate-sized embeddings; all weights are 32-bit."""

    NAMES = ("embed", "recur", "gate_bias", "class_w", "class_b", "tail_w", "tail_b", "word_w", "word_b")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def start(class_mass: np.ndarray, word_mass: np.ndarray) -> Model:
        """Small fixed random weights; output biases give the unigram shares."""
        rng = np.random.default_rng(1)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        w = {"embed": small(INPUTS, 3 * HIDDEN), "recur": small(HIDDEN, 3 * HIDDEN), "gate_bias": np.zeros(3 * HIDDEN, np.float32)}
        top = np.append(class_mass[:OWN], class_mass[OWN:].sum())
        w |= {"class_w": small(HIDDEN, OWN + 1), "class_b": np.log(top + 0.5).astype(np.float32)}
        w |= {"tail_w": small(HIDDEN, TAILS + 1), "tail_b": np.log(class_mass[OWN:] + 0.5).astype(np.float32)}
        w |= {"word_w": small(VOCABULARY // CLASS_WORDS, HIDDEN, CLASS_WORDS), "word_b": np.log(word_mass + 0.1).astype(np.float32).reshape(-1, CLASS_WORDS)}
        return Model(w)

    def pack(self) -> bytes:
        return np.concatenate([self.w[n].ravel() for n in self.NAMES]).astype(np.float32).tobytes()

    @staticmethod
    def unpack(data: bytes | np.ndarray) -> Model:
        shapes = {n: x.shape for n, x in Model.start(np.ones(CLASSES), np.ones(VOCABULARY)).w.items()}
        flat, w, at = np.frombuffer(data, np.float32), {}, 0
        for n in Model.NAMES:
            size = int(np.prod(shapes[n]))
            w[n] = flat[at : at + size].reshape(shapes[n]).copy()
            at += size
        return Model(w)

    def run(self, inputs: np.ndarray, state: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
        """States after each step (steps, lanes, hidden), the last of which is the next start, and what backward() needs."""
        n, (steps, lanes), kind = HIDDEN, inputs.shape, state.dtype
        gates, inner = np.ascontiguousarray(self.w["recur"][:, : 2 * n]), np.ascontiguousarray(self.w["recur"][:, 2 * n :])
        states = np.empty((steps + 1, lanes, n), kind)
        states[0] = state
        kept = steps if keep else 1
        zr, cs, passed = np.empty((kept, lanes, 2 * n), kind), np.empty((kept, lanes, n), kind), np.empty((kept, lanes, n), kind)
        x = np.empty((lanes, 3 * n), kind)
        for t in range(steps):
            h, i = states[t], t if keep else 0
            x = np.take(self.w["embed"], inputs[t], axis=0, out=x, mode="clip")
            x += self.w["gate_bias"]
            u = np.matmul(h, gates, out=zr[i])
            u += x[:, : 2 * n]
            u *= 0.5
            np.tanh(u, out=u)
            u *= 0.5
            u += 0.5
            a = np.matmul(h, inner, out=passed[i])
            c = np.multiply(u[:, n:], a, out=cs[i])
            c += x[:, 2 * n :]
            np.tanh(c, out=c)
            new = np.subtract(h, c, out=states[t + 1])
            new *= u[:, :n]
            new += c
        return states[1:], (states, zr, cs, passed)

    def outputs(self, h: np.ndarray, kinds: np.ndarray, words: np.ndarray, learn: bool) -> tuple[np.ndarray, dict | None]:
        """Natural log-probabilities of the targets after states h; kinds: their classes, words: their own ids or -1."""
        w, n = self.w, HIDDEN
        full = {"class": np.concatenate((w["class_w"], w["class_b"][None])), "tail": np.concatenate((w["tail_w"], w["tail_b"][None]))}
        word_w = np.concatenate((w["word_w"], w["word_b"][:, None]), axis=1)
        # states lie between -1 and 1, so the weights bound the logits
        far = bool(max(np.abs(x).sum(axis=-2).max() for x in (*full.values(), word_w)) > LARGE)
        ones = _with_one(h)
        logp = np.zeros(len(h))
        grads = {"class": np.zeros_like(full["class"]), "tail": np.zeros_like(full["tail"]), "word": np.zeros_like(word_w), "h": np.zeros_like(h)} if learn else None
        rare = np.flatnonzero(kinds >= OWN)
        for name, rows, aims in (("class", None, np.minimum(kinds, OWN)), ("tail", rare, kinds[rare] - OWN)):
            width = full[name].shape[1]
            block = np.empty((min(len(aims), BLOCK), width), h.dtype)
            for i in range(0, len(aims), BLOCK):
                at, aim_at = slice(i, i + BLOCK) if rows is None else rows[i : i + BLOCK], aims[i : i + BLOCK]
                g = ones[at]
                p = np.matmul(g, full[name], out=block[: len(g)])
                aim, total = _exponents(p, aim_at, far)
                logp[at] += aim - np.log(total)
                if learn:  # the sums divide the narrow side of each product
                    p.ravel()[np.arange(len(g)) * width + aim_at] -= total
                    share = (1 / total)[:, None]
                    grads[name] += (g * share).T @ p
                    grads["h"][at] += (p @ w[f"{name}_w"].T) * share
        own = np.flatnonzero(words >= 0)
        own = own[np.argsort(kinds[own].astype(np.int16), kind="stable")]
        starts = np.searchsorted(kinds[own], np.arange(OWN + 1))
        present, first = np.flatnonzero(np.diff(starts)), 0
        while first < len(present):  # some classes at a time, of about BLOCK words or one
            last = max(first + 1, int(np.searchsorted(starts[present + 1], starts[present[first]] + BLOCK, side="right")))
            base, end = starts[present[first]], starts[present[last - 1] + 1]
            parts = [(c, slice(starts[c] - base, starts[c + 1] - base)) for c in present[first:last].tolist()]
            rows = own[base:end]
            g, e, inner = ones[rows], np.empty((len(rows), CLASS_WORDS), h.dtype), words[rows] % CLASS_WORDS
            for c, s in parts:
                np.matmul(g[s], word_w[c], out=e[s])
            aim, total = _exponents(e, inner, far)
            logp[rows] += aim - np.log(total)
            if learn:
                e.ravel()[np.arange(len(rows)) * CLASS_WORDS + inner] -= total
                share = (1 / total)[:, None]
                g *= share
                back = np.empty((len(rows), n), h.dtype)
                for c, s in parts:
                    np.matmul(g[s].T, e[s], out=grads["word"][c])
                    np.matmul(e[s], w["word_w"][c].T, out=back[s])
                back *= share
                grads["h"][rows] += back
            first = last
        if not learn:
            return logp, None
        return logp, {"class_w": grads["class"][:-1], "class_b": grads["class"][-1], "tail_w": grads["tail"][:-1], "tail_b": grads["tail"][-1], "word_w": grads["word"][:, :-1], "word_b": grads["word"][:, -1], "h": grads["h"]}

    def backward(self, inputs: np.ndarray, tape: tuple, into: np.ndarray, live: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of a window: into holds those of the states; the start state is not followed further back."""
        n = HIDDEN
        states, zr, cs, passed = tape
        recur = self.w["recur"].T.copy()
        # those of the gates' inputs; the last third once as the recurrent part has it and once as the input has it
        ga, gc = np.empty((*inputs.shape, 3 * n), states.dtype), np.empty((*inputs.shape, n), states.dtype)
        gh, work = np.zeros_like(states[0]), np.empty_like(states[0])
        for t in range(len(inputs) - 1, -1, -1):
            h, z, r, c = states[t], zr[t][:, :n], zr[t][:, n:], cs[t]
            gh += into[t]
            keep = np.multiply(gh, z)
            g = np.multiply(c, c, out=gc[t])
            np.subtract(1, g, out=g)
            gh -= keep
            g *= gh  # gh (1 - z) (1 - c c)
            gz = np.subtract(h, c, out=work)
            gz *= gh
            np.multiply(gz, z, out=ga[t, :, :n])
            gr = np.multiply(g, passed[t], out=work)
            gr *= r
            np.multiply(gr, np.subtract(1, r), out=ga[t, :, n : 2 * n])
            np.multiply(g, r, out=ga[t, :, 2 * n :])
            gh = np.matmul(ga[t], recur, out=gh)
            gh += keep
        g_recur = states[:-1].reshape(-1, n).T @ ga.reshape(-1, 3 * n)
        ga[:, :, 2 * n :] = gc
        flat, ids = ga.reshape(-1, 3 * n), np.where(live, inputs, INPUTS).ravel().astype(np.int16)
        order = np.argsort(ids, kind="stable")[: int(live.sum())]
        flat, ids = np.take(flat, order, axis=0), ids[order]
        cut = np.flatnonzero(np.concatenate((ids[:1] == ids[:1], ids[1:] != ids[:-1])))
        embed = np.add.reduceat(flat, cut)
        return {"recur": g_recur, "gate_bias": embed.sum(axis=0), "rows": ids[cut].astype(np.int64), "embed": embed}


class Learner:
    """Adagrad on a replica."""

    def __init__(self, model: Model):
        self.model = model
        self.seen = {n: np.full_like(x, 1e-3) for n, x in model.w.items()}

    def step(self, inputs: np.ndarray, kinds: np.ndarray, words: np.ndarray, live: np.ndarray, state: np.ndarray) -> np.ndarray:
        m = self.model
        states, tape = m.run(inputs, state, True)
        at = np.flatnonzero(live.ravel())
        if not len(at):
            return states[-1]
        h = states.reshape(-1, HIDDEN)[at]
        _, g = m.outputs(h, kinds.ravel()[at], words.ravel()[at], True)
        into = np.zeros((live.size, HIDDEN), np.float32)
        into[at] = g.pop("h")
        g |= m.backward(inputs, tape, into.reshape(*live.shape, HIDDEN), live)
        rows, scale = g.pop("rows"), np.float32(1 / len(at) ** 0.5)
        for n, x in g.items():
            x = x * scale
            if n == "embed":
                self.seen[n][rows] += x * x
                m.w[n][rows] -= RATE * x / np.sqrt(self.seen[n][rows])
            else:
                self.seen[n] += x * x
                m.w[n] -= RATE * x / np.sqrt(self.seen[n])
        return states[-1]


class Lexicon:
    """What a task needs to number words: own words, tail classes, and the counts of the most frequent words."""

    def __init__(self, hot: list[tuple[str, int]], tails: list[tuple[str, int, int]], n: int, v: int):
        self.n, self.v = n, v
        own = [w for w, _ in hot if w != END][: VOCABULARY - 1]
        self.own = {END: 0} | {w: i + 1 for i, w in enumerate(own)}
        self.end_count = next((c for w, c in hot if w == END), 0)
        self.words = pa.array([w for w, _ in hot], pa.large_string())
        self.hot_id = np.array([self.own.get(w, -1) for w, _ in hot], np.int64)
        self.hot_count = np.array([c for _, c in hot], np.int64)
        self.tails = pa.array([t for t, _, _ in tails[:TAILS] if t], pa.large_string())
        mass = np.zeros(TAILS + 1)
        kinds = np.zeros(TAILS + 1)
        for i, (_, c, k) in enumerate(tails):
            mass[min(i, TAILS)] += c
            kinds[min(i, TAILS)] += k
        self.tail_total = mass + kinds + 1  # add one for each word, and for any unseen one
        self.first_tail = OWN
        word_mass = np.zeros(VOCABULARY)
        for w, c in hot:
            if w in self.own:
                word_mass[self.own[w]] = c
        self.word_mass = word_mass
        self.class_mass = np.concatenate((word_mass.reshape(-1, CLASS_WORDS).sum(axis=1), mass))

    def tail_of(self, words: pa.Array) -> np.ndarray:
        at = pc.index_in(pc.utf8_slice_codeunits(words, start=-2), value_set=self.tails)
        return pc.fill_null(at, TAILS).to_numpy(zero_copy_only=False)

    def number(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every word: its own id or -1, its class, and its training count or -1 where only a join can tell."""
        coded = flat.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.words)
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
        own = np.where(at >= 0, self.hot_id[at] if len(self.hot_id) else -1, -1)
        count = np.where(at >= 0, self.hot_count[at] if len(self.hot_count) else -1, -1)
        kind = np.where(own >= 0, own // CLASS_WORDS, 0)
        rare = np.flatnonzero(own < 0)
        kind[rare] = self.first_tail + self.tail_of(coded.dictionary.take(pa.array(rare)))
        code = coded.indices.to_numpy(zero_copy_only=False)
        return own[code], kind[code], count[code]


def windows(lengths: np.ndarray, lanes: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Deals rows of the given lengths to lanes and walks them window by window.

    Yields (at, fresh): at[t, lane] is the position in the rows' joined tokens, or -1; fresh marks lanes whose row
    begins with this window. A row starts at a window's first step, so its state begins at zero there. Longest rows
    first; lanes without a row left are dropped, and windows grow longer as lanes get few.
    """
    first = np.cumsum(lengths) - lengths
    waiting = np.argsort(-lengths, kind="stable").tolist()[::-1]
    place = np.zeros(0, np.int64)
    left = np.zeros(0, np.int64)
    fresh = np.zeros(0, bool)
    lane = np.arange(0)
    while True:
        alive = left > 0
        lane, place, left = lane[alive], place[alive], left[alive]
        new = [waiting.pop() for _ in range(min(lanes - len(place), len(waiting)))]
        lane = np.concatenate((lane, np.full(len(new), -1, np.int64)))
        place = np.concatenate((place, first[new] if new else np.empty(0, np.int64)))
        left = np.concatenate((left, lengths[new] if new else np.empty(0, np.int64)))
        if not len(place):
            return
        fresh = lane < 0
        now = int(min(max(steps, steps * lanes // len(place)), LONGEST_WINDOW, max(left.max(), 1)))
        t = np.arange(now)[:, None]
        yield np.where(t < left, place + t, -1), np.where(fresh, -1, lane)
        lane = np.arange(len(place))
        place, left = place + now, left - now


def _tokens(col: pa.Array, lex: Lexicon):
    """Words of a chunk with the end of each text put in: words, own ids, classes, counts, inputs, row lengths."""
    flat, offsets = split_words(col, lower=True)
    own, kind, count = lex.number(flat)
    ends = offsets[1:]
    own, kind = np.insert(own, ends, 0), np.insert(kind, ends, 0)
    count = np.insert(count, ends, lex.end_count)
    own, kind, count = own.astype(np.int32), kind.astype(np.int32), count.astype(np.int64)
    code = np.where(own >= 0, own, VOCABULARY + kind - lex.first_tail).astype(np.int32)
    lengths = np.diff(offsets) + 1
    inputs = np.empty_like(code)
    if len(code):
        inputs[1:] = code[:-1]
        inputs[np.cumsum(lengths) - lengths] = 0  # a text begins after an end
    return flat, offsets, own, kind, count, inputs, lengths


def _walk(lengths: np.ndarray, lanes: int, steps: int, visit) -> None:
    state = np.zeros((0, HIDDEN), np.float32)
    for at, lane in windows(lengths, lanes, steps):
        now = np.zeros((len(lane), HIDDEN), np.float32)
        now[lane >= 0] = state[lane[lane >= 0]]
        state = visit(at, at >= 0, now)


def _train(lexicon, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, learner, n = lexicon.value, Learner(Model.unpack(weights.value)), 0
        for _, col in text_chunks(batches, max_bytes=TEXT_BYTES):
            _, _, own, kind, _, inputs, lengths = _tokens(col, lex)
            n += len(own)
            _walk(lengths, LANES, STEPS, lambda at, live, state: learner.step(inputs[at], kind[at], own[at], live, state))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(n)]), pa.array([learner.model.pack()], pa.binary())], names=["replica", "n", "weights"])

    return run


def _mean(key: tuple, group: pa.Table) -> pa.Table:
    total, n = 0.0, 0.0
    for k, w in zip(group["n"].to_pylist(), group["weights"]):
        total = total + np.frombuffer(w.as_py(), np.float32) * k
        n += k
    return pa.table({"replica": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([n]), "weights": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())})


def averaged(replicas: DataFrame, fallback: bytes) -> bytes:
    """The replicas' mean by their words, in a tree: no group holds over FAN of them."""
    schema = "replica long, n double, weights binary"
    now = stored(replicas, "lm-replicas")
    top = now.agg(F.max("replica")).first()[0]
    while top is not None and top > 0:
        before, now = now, stored(now.groupBy(F.floor(F.col("replica") / FAN).alias("k")).applyInArrow(_mean, schema), "lm-replicas")
        drop_stored(before)
        top //= FAN
    row = now.select("weights").first()
    drop_stored(now)
    return bytes(row[0]) if row else fallback


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c): a task's counts, put together again whenever MERGE rows have come together."""
    kept: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(kept).combine_chunks().group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

    for _, col in text_chunks(batches, max_bytes=TEXT_BYTES):
        flat, offsets = split_words(col, lower=True)
        coded = flat.dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
        words = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END])])
        kept.append(pa.table({"word": words, "c": pa.array(np.append(n, len(offsets) - 1))}))
        if sum(map(len, kept)) > MERGE:
            kept = [merged()]
            if len(kept[0]) > MERGE // 2:  # mostly words that occur once
                yield from kept[0].select(["word", "c"]).to_batches()
                kept = []
    if kept:
        yield from merged().select(["word", "c"]).to_batches()


def _hottest(counts: DataFrame) -> list[tuple[str, int]]:
    """The most frequent words, HOT at most: those from the least count on that leaves so few."""
    level = F.floor(F.log2("c") * 32).cast("int")
    least, total = None, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # 32 rows for each doubling
        total += r["n"]
        if total > HOT:
            break
        least = r["level"]
    if least is None:
        return []
    rows = counts.where(level >= least).collect()
    return sorted(((r["word"], r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def _score(lexicon, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = lexicon.value, Model.unpack(weights.value)
        unit = np.log10(lex.n + lex.v + 1)
        tails = np.log10(lex.tail_total)
        for batch, col in text_chunks(batches, max_bytes=TEXT_BYTES):
            flat, offsets, own, kind, count, inputs, lengths = _tokens(col, lex)
            logp = np.zeros(len(own))

            def visit(at, live, state):
                states, _ = model.run(inputs[at], state, False)
                where = live.ravel()
                spot = at.ravel()[where]
                logp[spot], _ = model.outputs(states.reshape(-1, HIDDEN)[where], kind[spot], own[spot], False)
                return states[-1]

            _walk(lengths, SCORE_LANES, STEPS, visit)
            row = np.repeat(np.arange(len(lengths)), lengths)
            logc = np.log10(np.maximum(count, 0) + 1)
            score = logp / np.log(10) + np.where(own < 0, logc - tails[np.maximum(kind - lex.first_tail, 0)], 0)
            total = lambda x: np.bincount(row, weights=x, minlength=len(lengths))
            is_word = np.ones(len(own), bool)
            is_word[np.cumsum(lengths) - 1] = False
            open_ = (count < 0)[is_word]
            ends = np.concatenate(([0], np.cumsum(open_)))[offsets]
            words = flat.filter(pa.array(open_)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths), pa.array(total(count > 0).astype(np.int64)), pa.array(total(logc - unit)), pa.array(total(score)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words)],
                names=["doc_id", "n_tokens", "n_known", "base", "score", "open"],
            )

    return run


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def score_texts(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows that are not held out. docs needs doc_id (rows without one take no part) and
    text; other columns are ignored. Repeated rows each teach and are each scored. A null or empty text is its end alone. Without training texts the counts
    are zero and the model is its starting point.
    """
    spark = docs.sparkSession
    src = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    train = src.where(~held_out())
    counts = stored(train.mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0"), "lm-counts")
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
    hot = _hottest(counts)
    if END not in dict(hot):
        hot += [(r["word"], r["c"]) for r in counts.where(F.col("word") == END).collect()]
    own = set(Lexicon(hot, [], n, v).own)
    own_rows = spark.createDataFrame([(w,) for w in sorted(own)], "own string")
    rest = counts.join(F.broadcast(own_rows), F.col("word") == F.col("own"), "left_anti")  # VOCABULARY rows at most
    by_tail = stored(rest.groupBy(F.substring("word", -2, 2).alias("tail")).agg(F.sum("c").alias("c"), F.count("*").alias("k")), "lm-tails")
    tails = [(r["tail"], r["c"], r["k"]) for r in by_tail.orderBy(F.desc("c"), "tail").limit(TAILS).collect()]
    c, k = (int(x or 0) for x in by_tail.agg(F.sum("c"), F.sum("k")).first())
    tails += [("", 0, 0)] * (TAILS - len(tails)) + [("", c - sum(t[1] for t in tails), k - sum(t[2] for t in tails))]
    lex = Lexicon(hot, tails, n, v)
    lexicon = spark.sparkContext.broadcast(lex)
    weights = Model.start(lex.class_mass, lex.word_mass).pack()
    early = F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_ROUND)) == 0
    for part, words in ((train.where(early), n // FIRST_ROUND), (train.where(~early), n - n // FIRST_ROUND)):
        # fewer and larger parts where they are small; parts of a large table stay as they are
        replicas = part.coalesce(max(FEW_REPLICAS, words // REPLICA_WORDS)).mapInArrow(_train(lexicon, spark.sparkContext.broadcast(weights)), "replica long, n double, weights binary")
        weights = averaged(replicas, weights)
    scored = src.mapInArrow(_score(lexicon, spark.sparkContext.broadcast(weights)), "doc_id long, n_tokens long, n_known long, base double, score double, open array<string>")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")  # doc_ids can repeat; a written row's number stays
    # words beyond the most frequent: what a known one adds to both sums
    more = scored.select("row", F.explode("open").alias("word")).join(counts, "word")
    more = more.groupBy("row").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("c") + 1)).alias("add"))
    out = scored.drop("open").join(more, "row", "left")
    add = F.coalesce("add", F.lit(0.0))
    return out.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + add).alias("base_score"), (F.col("score") + add).alias("score"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
