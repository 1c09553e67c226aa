"""Chat formatting: a hidden Markov model recovers who speaks in a transcript's lines, then turns are rendered.

States are a role and whether the line begins its turn. A line is observed through the speaker marker that it starts
with, if any, and through its form: how long it is, whether it asks, whether it comes first. Starts, transitions and
emissions are counted on labelled transcripts. Viterbi's recursion multiplies matrices in the (max, +) semiring, which
is associative: lines are dealt in blocks of a conversation, each block is reduced to small matrices of CHUNK lines,
the matrices of a conversation fix each chunk's first and last state, and every chunk then finds its own best path
between these. So a conversation of any length is decoded in parallel, with the result of a single pass, and no more
than a chunk's lines are held at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchglass.llm.common import FOLDS, HELD_OUT_FOLD, stored, table

#: The last one stands for every other role: tools, functions and what has no name.
ROLES = ("system", "user", "assistant", "other")
STATES = tuple((role, begins) for role in ROLES for begins in (True, False))
#: Spellings of speaker markers, in lower case, and the role that each names.
MARKERS = {
    "system": "system", "instruction": "system", "context": "system",
    "user": "user", "human": "user", "question": "user", "q": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant",
    "tool": "other", "function": "other", "other": "other",
}
MARKER = re.compile(r"\s*(?:<\|(\w+)\|>|###\s*(\w+)\s*:|\[(\w+)\]\s*:?|(\w+)\s*:)[ \t]*", re.IGNORECASE)
#: Conversations learned from, at most; how sure rare events are kept possible.
CONVERSATIONS, SMOOTHING = 2000, 0.5
#: Lines reduced to one matrix, and held at once.
CHUNK = 4096
#: A turn's lines are numbered from the turn times TURN; a block holds the lines of 64 turns.
TURN = 1 << 32
BLOCK = 64 * TURN
LENGTHS = (0, 1, 20, 60, 120, 250, 500, 1000)


def split_marker(line: str) -> tuple[str | None, str]:
    """The role that a line's speaker marker names, and the line without it."""
    found = MARKER.match(line)
    role = MARKERS.get(next(g for g in found.groups() if g).lower()) if found else None
    return (role, line[found.end() :]) if role else (None, line)


def observe(line: str | None, first: bool) -> tuple[int, int]:
    """Numbers of the marker seen and of the line's form."""
    role, rest = split_marker(line or "")
    length = int(np.searchsorted(LENGTHS, len(rest.strip()), "right")) - 1
    form = (length * 2 + rest.rstrip().endswith("?")) * 2 + first
    return (1 + ROLES.index(role) if role else 0), form


FORMS = len(LENGTHS) * 4


@dataclass(frozen=True)
class Model:
    """Logarithms of chances."""

    start: np.ndarray  # states
    move: np.ndarray  # states x states
    marker: np.ndarray  # states x markers
    form: np.ndarray  # states x forms

    def emission(self, line: str | None, first: bool) -> np.ndarray:
        marker, form = observe(line, first)
        return self.marker[:, marker] + self.form[:, form]


class Counts:
    """How often a model's events were seen."""

    def __init__(self) -> None:
        n = len(STATES)
        self.start, self.move = np.zeros(n), np.zeros((n, n))
        self.marker, self.form = np.zeros((n, 1 + len(ROLES))), np.zeros((n, FORMS))

    def add(self, line: str | None, state: int, last: int | None, first: bool) -> None:
        """Counts a line; of the first one of what is counted here, the state before it may be unknown (None)."""
        seen, shape = observe(line, first)
        if first:
            self.start[state] += 1
        elif last is not None:
            self.move[last, state] += 1
        self.marker[state, seen] += 1
        self.form[state, shape] += 1

    def model(self) -> Model:
        """Smoothed logarithms. A line that begins no turn keeps its turn's role; the first line begins one."""
        allowed = np.array([[b or role == other for role, b in STATES] for other, _ in STATES])
        counted = ((self.start + SMOOTHING) * [b for _, b in STATES], (self.move + SMOOTHING) * allowed, self.marker + SMOOTHING, self.form + SMOOTHING)
        with np.errstate(divide="ignore"):
            return Model(*[np.log(x / x.sum(-1, keepdims=True)) for x in counted])


def train(transcripts: Sequence[Sequence[tuple[str, str, bool]]]) -> Model:
    """A model of transcripts of (line, role, begins)."""
    counts = Counts()
    for lines in transcripts:
        last = None
        for line, role, begins in lines:
            state = STATES.index((role, begins))
            counts.add(line, state, last, last is None)
            last = state
    return counts.model()


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).max(1)


def viterbi(emissions: np.ndarray, enter: np.ndarray, move: np.ndarray, leave: int | None = None) -> list[int]:
    """Best states for lines of known emissions, given the log chances to enter each state at the first line.

    ``leave`` fixes the last state. Of equally likely paths the one of smaller states from the end on is taken.
    """
    best, back = enter + emissions[0], []
    for e in emissions[1:]:
        ways = best[:, None] + move
        back.append(ways.argmax(0))
        best = ways.max(0) + e
    path = [int(best.argmax()) if leave is None else leave]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list[dict]]]:
    """Rows, which come sorted, by conversation, block and number of the chunk in it: a chunk at a time is held."""
    key, number, rows = None, 0, []
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["conv_id"], row["block"])
            if now != key or len(rows) == CHUNK:
                if rows:
                    yield (*key, number), rows
                key, number, rows = now, number + 1 if now == key else 0, []
            rows.append(row)
    if rows:
        yield (*key, number), rows


def _emissions(model: Model, rows: list[dict], first: bool) -> np.ndarray:
    return np.array([model.emission(r["line"], first and i == 0) for i, r in enumerate(rows)])


REDUCED = "conv_id long, block long, chunk int, matrix binary, opening binary"


def _reduce(model: Model):
    """From each state before a chunk to each at its end: the best path's log chance; the same for a chunk that opens its conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv_id, block, chunk), rows in _chunks(batches):
            rest = np.where(np.eye(len(STATES), dtype=bool), 0.0, -np.inf)
            for x in _emissions(model, rows[1:], False):
                rest = _times(rest, model.move + x)
            matrix = _times(model.move + model.emission(rows[0]["line"], False), rest)
            opening = _times((model.start + model.emission(rows[0]["line"], True))[None], rest)
            values = [conv_id, block, chunk, matrix.tobytes(), opening.tobytes()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in REDUCED.split(", ")])

    return run


FIXED = "conv_id long, block long, chunk int, before int, leave int"


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk the state before it (-1: it opens the conversation) and its last state, on the whole's best path."""
    from itertools import groupby

    n = len(STATES)
    chunks = (tuple(r.values()) for b in batches for r in b.to_pylist())
    for conv_id, group in groupby(chunks, lambda r: r[0]):
        places, best, back = [], None, []
        for _, block, chunk, matrix, opening in group:
            if best is None:
                best = np.frombuffer(opening)
            else:
                ways = best[:, None] + np.frombuffer(matrix).reshape(n, n)
                back.append(ways.argmax(0).astype(np.int8))
                best = ways.max(0)
            places.append((block, chunk))
        ends = [int(best.argmax())]
        for step in reversed(back):
            ends.append(int(step[ends[-1]]))
        ends.reverse()
        columns = [[conv_id] * len(ends), [p[0] for p in places], [p[1] for p in places], [-1, *ends[:-1]], ends]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in FIXED.split(", ")])


PARSED = "conv_id long, line_no long, role string, begins boolean, rendered string"


def rendered(line: str, role: str, begins: bool) -> str:
    """A line of the canonical form: a turn begins with its role's mark, which takes the place of a marker naming it."""
    if not begins:
        return line
    named, rest = split_marker(line)
    return f"<|{role}|>\n" + (rest if named == role else line)


def _decode(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv_id, _, chunk), rows in _chunks(batches):
            before, leave = rows[0]["fixed"][chunk]["before"], rows[0]["fixed"][chunk]["leave"]
            enter = model.start if before < 0 else model.move[before]
            path = [STATES[s] for s in viterbi(_emissions(model, rows, before < 0), enter, model.move, leave)]
            texts = [rendered(r["line"], role, begins) for (role, begins), r in zip(path, rows, strict=True)]
            columns = [[conv_id] * len(rows), [r["line_no"] for r in rows], [p[0] for p in path], [p[1] for p in path], texts]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()), strict=True)], [x.split()[0] for x in PARSED.split(", ")])

    return run


def _dealt(lines: DataFrame, block: int, more: Sequence[str] = ()) -> DataFrame:
    """(block, conv_id, line_no, line, ...) of the usable lines, repeated rows once, written to a table."""
    usable = lines.select(F.col("conv_id").cast("long"), F.col("line_no").cast("long"), F.col("line").cast("string"), *more).dropna(subset=["conv_id", "line_no", "line"])
    once = usable.distinct().withColumn("block", F.floor(F.col("line_no") / F.lit(block)).cast("long") if block < TURN else F.expr(f"line_no div {block}L - if(line_no % {block}L < 0, 1, 0)"))
    return stored(once.select("conv_id", "block", "line_no", "line", *more), "transcript-lines")


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "line_no", "line")


def parse(lines: DataFrame, model: Model, block: int = BLOCK) -> DataFrame:
    """(conv_id, line_no, role, begins, rendered) of each line of the transcripts in ``lines`` (conv_id, line_no, line).

    ``rendered`` is the line, after ``<|role|>`` and a line feed if it begins a turn, where a marker that names the
    role goes; nothing else is taken from a line. So a conversation's lines in order, joined by line feeds, are its
    canonical form. ``block`` is the range of line numbers that one task decodes at least; it doesn't change the
    result. Rows with a null conv_id, line_no or line take no part; rows that are alike count once; different lines at
    one place follow each other in the order of their texts. An empty line is a line. Lines and turns may have any
    length. An empty table gives no rows. Other columns of ``lines`` are not read.
    """
    dealt = _dealt(lines, block)
    matrices = _by_block(dealt).mapInArrow(_reduce(model), REDUCED)
    fixed = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "block", "chunk").mapInArrow(_between, FIXED)
    # A row for each chunk of CHUNK lines, so a block's are few.
    listed = fixed.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("chunk", "before", "leave"))).alias("fixed"))
    return _by_block(dealt.join(listed, ["conv_id", "block"])).mapInArrow(_decode(model), PARSED)


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, line_no, line, role, begins): conversations as transcripts, in one of four styles by the conversation.

    Turns are marked "User:", "### Human:" or "<|user|>"; in the fourth style, every other turn has no marker at all.
    Lines are numbered so that the turn and the line in it give the place. A null text is an empty line. Roles other
    than system, user and assistant, and null ones, are "other". Rows with a null conv_id or turn take no part, and
    rows that are alike count once; different rows of one turn follow each other, in the order of role and text.
    """
    role = F.lower(F.col("role").cast("string"))
    usable = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(role.isin(*ROLES), role).otherwise("other").alias("role"),
        F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n").alias("lines"),
    )
    usable = usable.dropna(subset=["conv_id", "turn"]).distinct()
    before = Window.partitionBy("conv_id", "turn").orderBy("role", "lines").rowsBetween(Window.unboundedPreceding, -1)
    usable = usable.withColumn("skip", F.coalesce(F.sum(F.size("lines")).over(before), F.lit(0)))
    style = F.crc32(F.col("conv_id").cast("string")) % 4
    named = F.initcap("role")
    human = F.when(F.col("role") == "user", "Human").otherwise(named)
    marker: Column = (
        F.when(style == 0, F.concat(named, F.lit(": ")))
        .when(style == 1, F.concat(F.lit("### "), human, F.lit(": ")))
        .when(style == 2, F.concat(F.lit("<|"), F.col("role"), F.lit("|> ")))
        .otherwise(F.when(F.col("turn") % 2 == 0, F.concat(named, F.lit(": "))).otherwise(F.lit("")))
    )
    spread = usable.select("conv_id", "turn", "skip", "role", marker.alias("marker"), F.posexplode("lines").alias("at", "plain"))
    return spread.select(
        "conv_id",
        (F.col("turn") * TURN + F.col("skip") + F.col("at")).alias("line_no"),
        F.when(F.col("at") == 0, F.concat("marker", "plain")).otherwise(F.col("plain")).alias("line"),
        "role",
        (F.col("at") == 0).alias("begins"),
    )


COUNTED = "kind string, i int, j int, n double"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts, as rows; what leads into a chunk is not counted here."""
    counts, edges = Counts(), []
    for (conv_id, block, chunk), rows in _chunks(batches):
        states, last = [STATES.index((r["role"], r["begins"])) for r in rows], None
        for row, state in zip(rows, states, strict=True):
            counts.add(row["line"], state, last, row["opens"])
            last = state
        edges.append((conv_id, block, chunk, states[0], states[-1]))
    out = []
    for kind in ("move", "marker", "form"):
        table_ = getattr(counts, kind)
        out += [(kind, int(i), int(j), float(table_[i, j])) for i, j in zip(*np.nonzero(table_), strict=True)]
    out += [("start", int(i), 0, float(counts.start[i])) for i in np.flatnonzero(counts.start)]
    out = [(*r, None, None, None) for r in out] + [("edge", first, last, 0.0, *place) for *place, first, last in edges]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
    names = ["kind", "i", "j", "n", "conv_id", "block", "chunk"]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names)


def fit(lines: DataFrame, conversations: int = CONVERSATIONS, block: int = BLOCK) -> Model:
    """Counts at most ``conversations`` labelled conversations outside the held-out fold, chosen by their ids' hashes.

    The chosen ones are counted whole, where their lines are: the driver gets sums only.
    """
    ids = lines.select("conv_id").distinct().filter(F.crc32(F.col("conv_id").cast("string")) % FOLDS != HELD_OUT_FOLD)
    chosen = ids.orderBy(F.xxhash64("conv_id"), "conv_id").limit(conversations)
    dealt = _dealt(lines.join(F.broadcast(chosen), "conv_id"), block, ["role", "begins"])  # so many ids
    opens = dealt.groupBy("conv_id").agg(F.min(F.struct("line_no", "line", "role", "begins")).alias("first"))
    place = F.struct("line_no", "line", "role", "begins")
    known = dealt.join(F.broadcast(opens), "conv_id").withColumn("opens", place == F.col("first")).drop("first")  # a line of each
    counted = stored(_by_block(known).mapInArrow(_count, COUNTED + ", conv_id long, block long, chunk int"), "transcript-counts")
    # From the last state of a chunk to the first one of the next.
    order = Window.partitionBy("conv_id").orderBy("block", "chunk")
    steps = counted.filter("kind = 'edge'").withColumn("from", F.lag("j").over(order)).filter(F.col("from").isNotNull())
    steps = steps.select(F.lit("move").alias("kind"), F.col("from").alias("i"), F.col("i").alias("j"), F.lit(1.0).alias("n"))
    sums = counted.filter("kind <> 'edge'").select("kind", "i", "j", "n").unionByName(steps).groupBy("kind", "i", "j").agg(F.sum("n").alias("n"))
    counts = Counts()
    for r in sums.collect():  # as many as the tables have places
        if r["kind"] == "start":
            counts.start[r["i"]] += r["n"]
        else:
            getattr(counts, r["kind"])[r["i"], r["j"]] += r["n"]
    return counts.model()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = transcripts(table(spark, sf_dir, "conversations"))
    return parse(lines, fit(lines)).select("conv_id", "line_no", "role", "begins", "rendered")
