"""Chat formatting by transcript parsing (operator 5).

A transcript's lines carry evidence of who speaks: speaker markers ("User:", "### Assistant", a role column),
where a line stands in its turn, its length, whether it asks something. A hidden Markov model with the
roles as states combines them; Viterbi's best path recovers the roles, also of lines without a marker or with
an unknown one. Lines are then put together into turns and rendered in one canonical form.

Probabilities are counts over labelled conversations (plain aggregations). Viterbi runs on segments of
``SEGMENT`` lines, so that one conversation never has to fit in one task, whatever its turn numbers: lines are sorted
by ranges and cut by their rank in the range. Each segment gives the best scores and ways
from every role before it to every role at its end (max-plus matrices). The small matrices are put together, ``SPAN`` at a
time, and then per conversation; that fixes the roles at the ends of all segments, and with them one way through
each. That equals one long run. All segments of a batch of rows take each step together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, stored, table

ROLES = ("system", "user", "assistant")
#: Names that speakers are given, by role. Fixed values.
SPEAKERS = {
    "system": "system instruction instructions context",
    "user": "user human question q customer prompt you me",
    "assistant": "assistant ai bot answer a agent model gpt response",
}
_NAMES = "|".join(sorted((w for s in SPEAKERS.values() for w in s.split()), key=len, reverse=True))
#: "User:", "**Human** -", "### Response", "[assistant]:", "<|user|>" at the start of a line.
MARKER = rf"^\s*(?:#+\s*(?:{_NAMES})\s*(?::|$)|[*_]{{1,2}}(?:{_NAMES}):?[*_]{{1,2}}\s*[:>-]?|\[(?:{_NAMES})\]\s*:?|<\|?(?:{_NAMES})\|?>|(?:{_NAMES})\s*:)\s*"

SEGMENT = 256
#: Segments of a conversation that are put together before the conversation's spans are chained.
SPAN = 256
LENGTHS = 5  # classes of line lengths


@dataclass(frozen=True)
class Model:
    """Log probabilities. move[b][i][j]: from role i to j within a turn (b = 0) or into a new one (1); first: of the first
    line; mark[b][j][m]: marker m (0 none, 1 + role); size[j][c], asks[j][q]."""

    first: np.ndarray
    move: np.ndarray
    mark: np.ndarray
    size: np.ndarray
    asks: np.ndarray

    def emissions(self, new: np.ndarray, marker: np.ndarray, size: np.ndarray, asks: np.ndarray) -> np.ndarray:
        """Lines x roles."""
        return self.mark[new, :, marker] + self.size[:, size].T + self.asks[:, asks].T


def speaker(name: Column) -> Column:
    """0: none; 1, 2, 3: the marker's role."""
    name, out = F.lower(F.trim(name)), F.lit(0)
    for i, role in enumerate(ROLES):
        out = F.when(name.isin(*SPEAKERS[role].split()), F.lit(i + 1)).otherwise(out)
    return F.coalesce(out, F.lit(0)).cast("int")


def lines_of(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, copy, rep, line, body, new, marker, size, asks: one row per line, and one for a turn without text.

    A marker that opens a line beats the role column, which only marks a turn's first line; it is cut off."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("given"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(text_col).isNull().alias("empty"))
    # rows that repeat a conversation's turn keep apart by their content; without a number, equal rows are turns of their own
    # and keep apart by a number that may be any, as they are equal
    rows = rows.withColumns({"copy": F.xxhash64(F.col("given").isNull(), F.coalesce("given", F.lit("")), "empty", "text"), "rep": F.when(F.col("turn").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))})
    lines = rows.select("conv", "turn", "copy", "rep", "given", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    found = F.regexp_extract("raw", f"(?i){MARKER}", 0)
    lines = lines.withColumns({"cut": F.length(found), "inline": speaker(F.regexp_extract(found, f"(?i)({_NAMES})", 1))})
    body = F.expr("substring(raw, cut + 1)")
    new = (F.col("line") == 0) | (F.col("inline") > 0)
    marker = F.when(F.col("inline") > 0, F.col("inline")).when(F.col("line") == 0, speaker(F.col("given"))).otherwise(F.lit(0))
    n = F.length(F.col("raw"))
    size = F.when(n == 0, 0).when(n < 40, 1).when(n < 120, 2).when(n < 400, 3).otherwise(4)
    return lines.select("conv", "turn", "copy", "rep", "line", "given", body.alias("body"), new.cast("int").alias("new"), marker.cast("int").alias("marker"), size.cast("int").alias("size"), F.col("raw").contains("?").cast("int").alias("asks"))


def train(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", unmarked: float = 0.25) -> Model:
    """A model from labelled turns; what reaches the driver is one row per combination of classes.

    ``unmarked`` is the share of turns whose speaker marker is expected to be missing."""
    known = F.col("role_") > 0
    lines = lines_of(turns, conv_col, turn_col, role_col, text_col).withColumn("role_", speaker(F.col("given"))).filter(known)
    counts = lines.groupBy("role_", "new", "size", "asks").agg(F.count(F.lit(1)).alias("n")).collect()
    heads = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), speaker(F.col(role_col)).alias("role_")).filter(known).groupBy("conv", "turn").agg(F.min("role_").alias("role_"))
    # an equi-join of each turn with the one before: no conversation is gathered in one task
    before = heads.select("conv", (F.col("turn") + 1).alias("turn"), F.col("role_").alias("before"))
    moves = heads.join(before, ["conv", "turn"], "left").groupBy("before", "role_").agg(F.count(F.lit(1)).alias("n")).collect()
    k = len(ROLES)
    first, move, size, asks = np.ones(k), np.ones((2, k, k)), np.ones((k, LENGTHS)), np.ones((k, 2))
    for r in moves:
        if r["before"] is None:
            first[r["role_"] - 1] += r["n"]
        else:
            move[1, r["before"] - 1, r["role_"] - 1] += r["n"]
    for r in counts:
        size[r["role_"] - 1, r["size"]] += r["n"]
        asks[r["role_"] - 1, r["asks"]] += r["n"]
        if not r["new"]:
            move[0, r["role_"] - 1, r["role_"] - 1] += r["n"]
    move[0] += np.eye(k) * 1000  # within a turn the speaker stays
    mark = np.full((2, k, k + 1), 1e-4)
    mark[1, :, 0], mark[0, :, 0] = unmarked, 1.0
    for j in range(k):
        mark[1, j, j + 1] = 1.0 - unmarked
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Model(log(first), log(move), log(mark), log(size), log(asks))


def _lesser_first(codes: np.ndarray) -> np.ndarray:
    """Ranks along the second axis from the last but one."""
    return codes.argsort(axis=-2, kind="stable").argsort(axis=-2, kind="stable")


def _together(scores: np.ndarray, ranks: np.ndarray, then: np.ndarray, then_ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, ranks, role between) of ways that are put together, for many at once.

    ``scores``: ... x before x middle, ``then``: ... x middle x end. ``ranks`` orders the ways to the same end as one long run does
    that breaks ties by the lesser role, looking back from the end: so the later part decides first."""
    way = scores[..., :, :, None] + then[..., None, :, :]
    best = way.max(axis=-2)
    # only the middle roles that tie take part, the least way onwards wins
    between = np.where(way == best[..., None, :], then_ranks[..., None, :, :], 1 << 20).argmin(axis=-2)
    onwards = np.take_along_axis(np.broadcast_to(then_ranks[..., None, :, :], way.shape), between[..., None, :], axis=-2)[..., 0, :]
    here = np.take_along_axis(np.broadcast_to(ranks[..., :, :, None], way.shape), between[..., None, :], axis=-2)[..., 0, :]
    return best, _lesser_first(onwards * scores.shape[-2] + here), between


def _folded(lengths: np.ndarray, element) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sequences of these lengths put together step by step, all at once, the longest ones first in order.

    ``element(t, n)`` gives scores (before x end; the last row: nothing before) and ranks of the first ``n`` sequences' element t.
    Back come scores, ranks and the roles between, by step."""
    scores, ranks = (x.copy() for x in element(0, len(lengths)))
    between = []
    for t in range(1, int(lengths.max(initial=0))):
        n = int((lengths > t).sum())
        then, then_ranks = element(t, n)
        scores[:n], ranks[:n], m = _together(scores[:n], ranks[:n], then[:, :-1], then_ranks[:, :-1])
        between.append(m.astype(np.int8))
    return scores, ranks, between


def _ways(lengths: np.ndarray, between: list[np.ndarray], before: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The role at each step of each sequence (steps x sequences x ...) for these roles before it and at its end."""
    path = np.zeros((int(lengths.max()), *end.shape), np.int8)
    path[:] = end
    which = np.arange(len(lengths)).reshape(-1, *[1] * (end.ndim - 1))
    for t in range(len(path) - 1, 0, -1):
        n = int((lengths > t).sum())
        path[t - 1, :n] = between[t - 1][which[:n], before[:n], path[t, :n]]
    return path


def _groups(batches, columns: list[str]):
    """Whole groups of rows in a row that agree in ``columns``: (table, starts, lengths), some thousand rows at a time."""
    held: pa.Table | None = None

    def cut(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in columns:
            x = t[c].combine_chunks()
            a, b = x.slice(0, len(x) - 1), x.slice(1)
            differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
            new[1:] |= differ
        return np.flatnonzero(new)

    def out(t: pa.Table, starts: np.ndarray):
        return t, starts, np.diff(np.append(starts, t.num_rows))

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        starts = cut(held)
        if len(starts) > 1:
            yield out(held.slice(0, int(starts[-1])), starts[:-1])
            held = held.slice(int(starts[-1]))
    if held is not None and held.num_rows:
        yield out(held, cut(held))


def segmented(lines: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Lines, repeats once, with ``place``, which grows along each conversation, and ``segment``: at most so many lines in a row.

    A range of the sort is a task's, and a conversation may lie across any number of ranges. Places hold as they are stored."""
    order = ["conv", "turn", "copy", "rep", "line"]
    placed = lines.dropDuplicates(order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return stored(placed.drop("given"), "chat-lines").withColumn("segment", F.floor(F.col("place") / segment).cast("long"))


def parse(turns: DataFrame, model: Model, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Canonical turns: conv_col, turn_col, part (from 0 within a given turn), role, n_lines, rendered.

    A turn splits where the recovered role changes. Null texts are empty turns, null or unknown roles are missing markers,
    turns without a number come first; rows that repeat a conversation's turn are ordered by a hash of their content,
    and exact repeats of a numbered turn are one turn; without a number each row is a turn. A null conversation is one conversation. Ties go to the first of ``ROLES``."""
    # multiples of 2^-20 are added without rounding, so that sums and ties do not depend on where segments are cut
    exact = Model(*[np.round(x * (1 << 20)) / (1 << 20) for x in (model.first, model.move, model.mark, model.size, model.asks)])
    shared = turns.sparkSession.sparkContext.broadcast(exact)
    lines = segmented(lines_of(turns, conv_col, turn_col, role_col, text_col), segment)
    features = lines.select("conv", "segment", "place", "new", "marker", "size", "asks")
    conv = features.schema["conv"].dataType.simpleString()
    k = len(ROLES)
    entries = k * (k + 1)  # roles before, or nothing, x roles at the end

    def matrices(column: pa.ChunkedArray, n: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, k + 1, k)

    def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), kind), entries).cast(pa.list_(kind))

    def measure(batches):
        model = shared.value
        for t, starts, lengths in _groups(batches, ["conv", "segment"]):
            order = np.argsort(-lengths, kind="stable")
            first, size = starts[order], lengths[order]
            new, marker, sizes, asks = (t[c].to_numpy() for c in ("new", "marker", "size", "asks"))
            emit = model.emissions(new, marker, sizes, asks)
            same = np.broadcast_to(np.append(np.arange(k), 0)[:, None], (k + 1, k))

            def element(i: int, n: int) -> tuple[np.ndarray, np.ndarray]:
                at = first[:n] + i
                scores = np.concatenate([model.move[new[at]], np.broadcast_to(model.first, (n, 1, k))], axis=1) + emit[at][:, None, :]
                return scores, np.broadcast_to(same, (n, k + 1, k)).copy()

            scores, ranks, between = _folded(size, element)
            every = np.broadcast_to(np.arange(k), (len(size), k + 1, k)), np.broadcast_to(np.arange(k + 1)[:, None], (len(size), k + 1, k))
            path = _ways(size, between, every[1], every[0]) if len(size) else np.zeros((0, 0, k + 1, k), np.int8)
            ways = [[path[:n, i, b, e].tobytes() for b in range(k + 1) for e in range(k)] for i, n in enumerate(size.tolist())]
            picked = t.select(["conv", "segment", "place"]).take(pa.array(first))
            columns = [*picked.columns, lists(scores, pa.float64()), lists(ranks.astype(np.int32), pa.int32()), pa.array(ways, pa.list_(pa.binary()))]
            yield from pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["conv", "segment", "first", "scores", "ranks", "ways"]).to_batches()

    def put_together(batches):
        for t, starts, lengths in _groups(batches, ["conv", "span"]):
            order = np.argsort(-lengths, kind="stable")
            first, size = starts[order], lengths[order]
            all_scores, all_ranks = matrices(t["scores"], t.num_rows), matrices(t["ranks"], t.num_rows)
            scores, ranks, _ = _folded(size, lambda i, n: (all_scores[first[:n] + i], all_ranks[first[:n] + i]))
            picked = t.select(["conv", "span"]).take(pa.array(first))
            yield from pa.table([*(c.combine_chunks() for c in picked.columns), lists(scores, pa.float64()), lists(ranks.astype(np.int32), pa.int32())], names=["conv", "span", "scores", "ranks"]).to_batches()

    def ends_of(columns: list[str], number: str):
        """Roles before (k: nothing) and at the end of each part of a whole, from those of the whole, or from nothing."""

        def fix(batches):
            for t, starts, lengths in _groups(batches, columns):
                order = np.argsort(-lengths, kind="stable")
                first, size = starts[order], lengths[order]
                all_scores, all_ranks = matrices(t["scores"], t.num_rows), matrices(t["ranks"], t.num_rows)
                scores, _, between = _folded(size, lambda i, n: (all_scores[first[:n] + i], all_ranks[first[:n] + i]))
                if "enter" in t.column_names:
                    before, end = t["enter"].to_numpy()[first], t["leave"].to_numpy()[first]
                else:
                    before = np.full(len(size), k)
                    end = scores[:, k].argmax(axis=1)
                path = _ways(size, between, before, end.astype(np.int8))
                enter, leave = np.zeros(t.num_rows, np.int32), np.zeros(t.num_rows, np.int32)
                for i, (a, n) in enumerate(zip(first.tolist(), size.tolist())):
                    leave[a : a + n] = path[:n, i]
                    enter[a], enter[a + 1 : a + n] = before[i], path[: n - 1, i]
                yield from pa.table([t["conv"].combine_chunks(), t[number].combine_chunks(), pa.array(enter), pa.array(leave)], names=["conv", number, "enter", "leave"]).to_batches()

        return fix

    kinds = f"conv {conv}, segment long, first long, scores array<double>, ranks array<int>, ways array<binary>"
    measured = stored(features.repartition("conv", "segment").sortWithinPartitions("conv", "segment", "place").mapInArrow(measure, kinds), "chat-segments")
    # a conversation's segments need not be numbered in a row, but a span has as many numbers as it may have segments
    small = measured.select("conv", "segment", F.floor(F.col("segment") / SPAN).cast("long").alias("span"), "scores", "ranks")
    spans = small.repartition("conv", "span").sortWithinPartitions("conv", "span", "segment").mapInArrow(put_together, f"conv {conv}, span long, scores array<double>, ranks array<int>")
    fixed = spans.repartition("conv").sortWithinPartitions("conv", "span").mapInArrow(ends_of(["conv"], "span"), f"conv {conv}, span long, enter int, leave int")
    fixed = fixed.withColumnsRenamed({"conv": "conv_", "span": "span_"})
    inside = small.join(fixed, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("span") == F.col("span_"))).select("conv", "span", "segment", "scores", "ranks", "enter", "leave")
    ends = inside.repartition("conv", "span").sortWithinPartitions("conv", "span", "segment").mapInArrow(ends_of(["conv", "span"], "segment"), f"conv {conv}, segment long, enter int, leave int")
    ends = ends.withColumnsRenamed({"conv": "conv_", "segment": "segment_"})
    way = measured.join(ends, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("segment") == F.col("segment_"))).select(F.col("conv").alias("conv_"), F.col("segment").alias("segment_"), "first", F.get("ways", F.col("enter") * k + F.col("leave")).alias("way"))
    placed = lines.join(way, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("segment") == F.col("segment_")))
    # a segment's lines have places in a row
    role_at = F.ascii(F.substring("way", (F.col("place") - F.col("first") + 1).cast("int"), F.lit(1)).cast("string"))
    placed = placed.select("conv", "turn", "copy", "rep", "line", "body", role_at.alias("role"))
    # a given turn is put together again, cut where the role changes; a turn's lines are one row's text
    each = placed.groupBy("conv", "turn", "copy", "rep").agg(F.array_sort(F.collect_list(F.struct("line", "role", "body"))).alias("lines"))
    roles = F.array(*map(F.lit, ROLES))
    starts = F.filter(F.transform("lines", lambda x, i: F.when((i == 0) | (x["role"] != F.get("lines", i - 1)["role"]), i)), lambda x: x.isNotNull())
    parts = each.withColumn("starts", starts).select("conv", "turn", "lines", F.posexplode(F.transform("starts", lambda s, i: F.slice("lines", s + 1, F.coalesce(F.get("starts", i + 1), F.size("lines")) - s))).alias("part", "run"))
    role = F.get(roles, F.get("run", F.lit(0))["role"])
    text = F.trim(F.array_join(F.transform("run", lambda x: x["body"]), "\n"), F.lit(SPACES))
    return parts.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "part", role.alias("role"), F.size("run").alias("n_lines"), render(role, text).alias("rendered"))


def render(role: Column, text: Column) -> Column:
    """One turn in canonical form; the delimiters within a text are broken up."""
    safe = F.replace(text, F.lit("<|"), F.lit("<\u200b|"))
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), safe, F.lit("\n<|end|>\n"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return parse(turns, train(turns))
