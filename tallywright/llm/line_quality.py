"""Quality of documents from a linear-chain conditional random field over their lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tallywright.llm import tables, textops
from tallywright.session import ship

ship(__name__)

SAMPLE_LINES, SAMPLE_DOC_LINES = 40_000, 512
SLICE_BYTES = 4 << 20

# classes of bytes: the share of each in a line is a feature
_KIND = np.zeros(256, np.uint8)
_KIND[128:] = 1
_KIND[97:123] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
_KIND[[32, 9, 11, 12, 13]] = 5
for _i, _marks in enumerate([".", ",;:", "!", "?", "|", "%&$*#@^~=+<>\\_", "'\"()[]{}-/"], 6):
    _KIND[list(_marks.encode())] = _i
_KINDS = 13
WIDTH = _KINDS + 9


@dataclass
class Model:
    """Unary weights of a bad line, the transition weights, and the document's scale.

    `weights` has one row per neighbour (line in front, line itself, line behind) and a
    bias; `chain[a, b]` is the weight of label b after a (0 good, 1 bad); a document's
    score is logistic in its share of bad text, `scale[0] + scale[1] * share`.
    """

    weights: np.ndarray
    bias: float
    chain: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def line_bounds(content: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and the number of lines before each text.

    A line ends before a line feed or with its text, so an empty text is one line.
    """
    feeds = np.flatnonzero(content == 10)
    starts = np.concatenate([bounds[:-1], feeds + 1])
    ends = np.concatenate([feeds, bounds[1:]])
    owner_of_feed = np.searchsorted(bounds, feeds, side="right") - 1
    texts = np.arange(len(bounds) - 1)
    order = np.lexsort((starts, np.concatenate([texts, owner_of_feed])))
    closing = np.lexsort((ends, np.concatenate([owner_of_feed, texts])))
    lines = np.bincount(owner_of_feed, minlength=len(texts)) + 1
    return starts[order], ends[closing], np.concatenate([[0], np.cumsum(lines)])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of features per line, the lines before each text, and bytes per line."""
    content, bounds = textops.flat(column)
    start, end, before = line_bounds(content, bounds)
    count, size = len(start), end - start
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(before))
    inside = np.repeat(np.arange(count), size)
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    kinds = np.bincount(inside * _KINDS + _KIND[content[at]], minlength=count * _KINDS).reshape(count, _KINDS)
    out = np.zeros((count, WIDTH), np.float32)
    out[:, :_KINDS] = kinds / np.maximum(size, 1)[:, None]
    hashes = textops.Hasher(content)
    edges = np.unique(np.concatenate([bounds, start, end]))
    first, last, _ = textops.words(content, edges)
    line = np.searchsorted(start, first, side="right") - 1
    words = np.bincount(line, minlength=count)
    spelled = hashes.of(first, last)
    again = np.zeros(len(first), bool)
    again[1:] = (spelled[1:] == spelled[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((spelled, line))
    new = np.ones(len(first), bool)
    new[1:] = (spelled[order][1:] != spelled[order][:-1]) | (line[order][1:] != line[order][:-1])
    per_word = 1 / np.maximum(words, 1)
    out[:, _KINDS] = np.log1p(size) / 5
    out[:, _KINDS + 1] = np.log1p(words) / 3
    out[:, _KINDS + 2] = np.minimum(np.bincount(line, last - first, minlength=count) * per_word, 40) / 10
    out[:, _KINDS + 3] = np.bincount(line, again, minlength=count) * per_word
    out[:, _KINDS + 4] = 1 - np.bincount(line[order], new, minlength=count) * per_word
    whole = hashes.of(start, end)
    order = np.lexsort((np.arange(count), whole, owner))
    seen = np.zeros(count, bool)
    seen[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    out[:, _KINDS + 5] = seen & (size > 0)
    out[:, _KINDS + 6] = size == 0
    out[before[:-1], _KINDS + 7] = 1
    out[before[1:] - 1, _KINDS + 8] = 1
    return out, before, size + 1


def _unary(rows: np.ndarray, before: np.ndarray, model: Model) -> np.ndarray:
    """Weight of each line being bad, from its own features and its neighbours'."""
    scaled = (rows - model.mean) / model.spread
    out = scaled @ model.weights[1] + model.bias
    if len(rows) > 1:
        front, behind = scaled[:-1] @ model.weights[0], scaled[1:] @ model.weights[2]
        joined = np.ones(len(rows) - 1, bool)
        joined[before[1:-1] - 1] = False
        out[1:] += np.where(joined, front, 0)
        out[:-1] += np.where(joined, behind, 0)
    return out


def marginals(unary: np.ndarray, before: np.ndarray, chain: np.ndarray):
    """Forward-backward over all texts at once, one step per line of the longest.

    Probability of a bad line, and for each line but a text's first that of the four
    pairs of labels with the line in front.
    """
    lines = np.diff(before)
    order = np.argsort(-lines, kind="stable")
    sizes, starts = lines[order], before[:-1][order]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")
    ahead = np.zeros((len(unary), 2))
    behind = np.zeros((len(unary), 2))
    weight = np.stack([np.zeros(len(unary)), unary], axis=1)
    for i in range(steps):
        at = starts[: alive[i]] + i
        if i == 0:
            ahead[at] = weight[at]
        else:
            was = ahead[at - 1]
            ahead[at, 0] = np.logaddexp(was[:, 0] + chain[0, 0], was[:, 1] + chain[1, 0])
            ahead[at, 1] = np.logaddexp(was[:, 0] + chain[0, 1], was[:, 1] + chain[1, 1]) + weight[at, 1]
    for i in reversed(range(steps - 1)):
        at = starts[: alive[i + 1]] + i
        then = behind[at + 1] + weight[at + 1]
        behind[at, 0] = np.logaddexp(then[:, 0] + chain[0, 0], then[:, 1] + chain[0, 1])
        behind[at, 1] = np.logaddexp(then[:, 0] + chain[1, 0], then[:, 1] + chain[1, 1])
    both = ahead + behind
    total = np.logaddexp(both[:, 0], both[:, 1])
    inner = np.ones(len(unary), bool)
    inner[before[:-1]] = False
    at = np.flatnonzero(inner)
    pairs = ahead[at - 1][:, :, None] + chain[None] + (behind[at] + weight[at])[:, None, :]
    return np.exp(both[:, 1] - total), np.exp(pairs - total[at, None, None]), at


def _share(probability: np.ndarray, before: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length-weighted mean probability of a bad line, per text."""
    return np.add.reduceat(probability * size, before[:-1]) / np.add.reduceat(size, before[:-1])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _scale(share: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the share of bad text, by Newton's method."""
    rows = np.stack([np.ones(len(share)), share], axis=1)
    out = np.zeros(2)
    for _ in range(25):
        p = _logistic(rows @ out)
        slope = rows.T @ (good - p) - 0.01 * out
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + 0.01 * np.eye(2)
        out += np.clip(np.linalg.solve(curve, slope), -5, 5)
    return out


def learn(rows: np.ndarray, before: np.ndarray, size: np.ndarray, good: np.ndarray, rounds: int = 4, steps: int = 60) -> Model:
    """Train on documents labelled as a whole.

    Lines of good documents count as good. Which lines of the others are bad is first
    taken to be all, then, round by round, what the field finds likely, at least one in
    each; the field's weights climb its conditional likelihood by Adam.
    """
    mean, spread = rows.mean(axis=0), rows.std(axis=0) + 0.05
    model = Model(np.zeros((3, WIDTH)), 0.0, np.zeros((2, 2)), np.zeros(2), mean, spread)
    scaled = (rows - mean) / spread
    owner = np.repeat(np.arange(len(good)), np.diff(before))
    joined = np.ones(len(rows), bool)
    joined[before[:-1]] = False
    sides = np.zeros((3, len(rows), WIDTH), np.float32)
    sides[1] = scaled
    sides[0][1:] = np.where(joined[1:, None], scaled[:-1], 0)
    sides[2][:-1] = np.where(joined[1:, None], scaled[1:], 0)
    wide = np.concatenate([*sides, np.ones((len(rows), 1), np.float32)], axis=1)
    bad_doc = good[owner] == 0
    target = bad_doc.astype(np.float64)
    weights, chain = np.zeros(wide.shape[1]), np.zeros((2, 2))
    moments = [np.zeros(wide.shape[1] + 4), np.zeros(wide.shape[1] + 4)]
    # each document weighs the same, both labels together too
    per_doc = np.where(good == 1, 0.5 / max((good == 1).sum(), 1), 0.5 / max((good == 0).sum(), 1))
    line_weight = (per_doc / np.diff(before))[owner]
    turn = 0
    for round_no in range(rounds):
        for _ in range(steps):
            probability, pairs, at = marginals(wide @ weights, before, chain)
            slope = wide.T @ (line_weight * (target - probability)) - 1e-4 * weights
            front, here = target[at - 1], target[at]
            wanted = np.stack([(1 - front) * (1 - here), (1 - front) * here, front * (1 - here), front * here], axis=1)
            bend = (line_weight[at, None] * (wanted - pairs.reshape(-1, 4))).sum(axis=0) - 1e-3 * chain.reshape(-1)
            step = np.concatenate([slope, bend])
            turn += 1
            moments[0] = 0.9 * moments[0] + 0.1 * step
            moments[1] = 0.99 * moments[1] + 0.01 * step * step
            move = 0.1 * (moments[0] / (1 - 0.9**turn)) / (np.sqrt(moments[1] / (1 - 0.99**turn)) + 1e-8)
            weights += move[:-4]
            chain = chain + move[-4:].reshape(2, 2)
        if round_no < rounds - 1:
            probability, _, _ = marginals(wide @ weights, before, chain)
            best = np.maximum.reduceat(probability, before[:-1])[owner]
            target = np.where(bad_doc, probability / np.maximum(best, 1e-9), 0.0)
    model.weights, model.bias, model.chain = weights[:-1].reshape(3, WIDTH), float(weights[-1]), chain
    probability, _, _ = marginals(_unary(rows, before, model), before, chain)
    model.scale = _scale(_share(probability, before, size), good)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_lines: int = SAMPLE_LINES) -> Model | None:
    """Learn from doc_id and text, doc_id and quality (0 or 1); None if nothing meets.

    A bounded sample fits the field: documents chosen by a hash of their key, half of
    the lines from each label, about `sample_lines` in all; a longer document than 512
    lines gives its share by its first 512. The lines of all labelled rows are counted
    to set the shares. Texts stay where they are: only keys and line counts meet the
    labels, and the chosen keys, fewer than `sample_lines`, go to the texts. Only
    features, 22 numbers a line, come to the driver.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    counted = texts.select("doc_id", F.least(lines, F.lit(SAMPLE_DOC_LINES)).alias("lines"))
    usable = counted.join(labels.where("quality IN (0, 1)").select("doc_id", "quality"), "doc_id")
    sizes = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.sum("lines").alias("n")).collect()}
    if not sizes:
        return None
    limit = sample_lines // 2
    share = F.lit(0.0)
    for label, size in sizes.items():
        share = F.when(F.col("quality") == label, min(1.0, limit / size)).otherwise(share)
    wanted = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    keys = tables.settled(wanted.select("doc_id", "quality").distinct(), "quality-sample")
    chosen = texts.join(keys, "doc_id").select("doc_id", "text", "quality")

    def run(batches):
        for batch in textops.slices(batches, size=SLICE_BYTES):
            rows, before, size = features(batch.column("text"))
            before = before.tolist()
            cut = [slice(a, min(b, a + SAMPLE_DOC_LINES)) for a, b in zip(before, before[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("quality").cast(pa.int32()),
                    pa.array([rows[c].tobytes() for c in cut], pa.binary()),
                    pa.array([size[c].astype(np.int64).tobytes() for c in cut], pa.binary()),
                ],
                ["doc_id", "quality", "rows", "sizes"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    sample = chosen.mapInArrow(run, f"doc_id {key}, quality int, rows binary, sizes binary").toPandas()
    sample = sample.sort_values(["quality", "rows"])
    if not len(sample):
        return None
    rows = [np.frombuffer(r, np.float32).reshape(-1, WIDTH) for r in sample["rows"]]
    sizes = np.concatenate([np.frombuffer(s, np.int64) for s in sample["sizes"]])
    before = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return learn(np.concatenate(rows), before, sizes, sample["quality"].to_numpy().astype(float))


def score(docs: DataFrame, model: Model | None, text_column: str = "text", threshold: float = 0.7) -> DataFrame:
    """Each row with `score` (0 to 1, higher for better text) and `predicted` (0 or 1).

    Whole texts are read; a missing text is empty, and an empty text is one empty line.
    Without a model every row has score 0.5. Equal texts have equal scores. Columns of
    these two names are replaced, all others kept.
    """
    kept = docs.drop("score", "predicted")
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches):
        for batch in textops.slices(batches, text_column, size=SLICE_BYTES):
            column = batch.column(batch.schema.get_field_index(text_column))
            if model is None:
                found = np.full(len(column), 0.5)
            else:
                rows, before, size = features(column)
                probability, _, _ = marginals(_unary(rows, before, model), before, model.chain)
                found = _logistic(model.scale[0] + model.scale[1] * _share(probability, before, size))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"],
            )

    return kept.mapInArrow(run, schema)
