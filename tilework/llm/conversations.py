"""Structure repair of conversations: the cheapest edits that give the role order ``(system? (user assistant)+)?``.

Keep costs 0, Rerole to user or assistant 1, Delete 2 (required for blank and duplicate turns), Insert of an empty user or assistant turn 5;
a truncated turn that is not deleted costs 5 more. Of the cheapest edit lists the one whose initials are least in ASCII order counts.
That is a shortest path over four states (nothing yet, after system, after user, after assistant).

**Rank-convergence parallel Viterbi.** Conversations are cut into chunks of ``chunk`` turns. Every chunk runs its backward
recursion from a speculative cost vector, that of a conversation which ends there. A fix-up pass hands each chunk the vector that its
successor found; chunks whose vector differs from the one they ran from by more than a constant run again, the old and the new vector
side by side, and stop where these differ by a constant, for from there on nothing but that constant changes. Passes end when no
vector changes. Constants are added up apart, so the stitched costs are exact. With its successor's vector known,
every chunk traces its least edits from each of the four states it may be entered in; the chain of states is then followed chunk by chunk.
Conversations that have not settled after ``most_passes`` (long runs of turns that all must be deleted carry any
vector on unchanged) take the exact way round: min-plus matrices of their chunks, combined in a logarithmic number of joins.

Turns get their places by range partitions, and faults by aggregation, so a conversation with a third of all turns spreads over
the cluster. Only its SHA-256, which is a sequential function of the whole repaired conversation, streams through one task:
turns come sorted, one batch at a time, and that task holds the edit initials of one conversation (a byte a turn).

Defined results: null role and text are one space; rows of one conversation go by turn (nulls first), then role, then SHA-256 of the
text; a role is judged by its first character, so unknown roles can be reroled or deleted; a null ``conv_id`` is a
conversation of its own; texts are read whole, and invalid UTF-8 reaches the hash as replacement characters; repeated rows are duplicates;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .places import placed

CHUNK = 1024
MOST_PASSES = 8
BLANKS = " \t\n\x0b\x0c\r"
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; conversations may end in 0 and 3.
USER, ASSISTANT = {0: 2, 1: 2, 3: 2}, {2: 3}
MOVES = {"s": {0: 1}, "u": USER, "a": ASSISTANT, "o": {}}
INSERT = {**USER, **ASSISTANT}
ROLE = {2: "user", 3: "assistant"}
KEEP, REROLE, DELETE, ADD, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 40
END = [0, 2 * ADD, ADD, 0]


def _options(code: str) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a turn, by initial: ``(initial, cost, next state)``. Codes: x must go, else the role's
    initial (o for others), in upper case if truncated."""
    more, out = TRUNCATED if code.isupper() else 0, []
    for state in range(4):
        edits = [("D", DELETE, state)]
        if code != "x":
            if state in MOVES[code.lower()]:
                edits.append(("K", KEEP + more, MOVES[code.lower()][state]))
            edits.append(("R", REROLE + more, INSERT[state]))
        out.append(edits)
    return out


OPTIONS = {c: _options(c) for c in "xsuaoSUAO"}


def _before(code: str, after: list[int]) -> list[int]:
    """Costs to go before a turn from those after it, with insertions before the turn."""
    now = [min(cost + after[to] for _, cost, to in edits) for edits in OPTIONS[code]]
    return [min(now[s], ADD + now[INSERT[s]], 2 * ADD + now[INSERT[INSERT[s]]]) for s in range(4)]


def costs_at_start(codes: str, after: list[int]) -> list[int]:
    for code in reversed(codes):
        after = _before(code, after)
    return after


def rerun(codes: str, old: list[int], start: list[int], new: list[int]) -> list[int]:
    """Costs at the start from ``new``, given ``start`` from ``old``: both run until they differ by a constant."""
    for code in reversed(codes):
        apart = [b - a for a, b in zip(old, new, strict=True)]
        if min(apart) == max(apart):
            return [x + apart[0] for x in start]
        old, new = _before(code, old), _before(code, new)
    return new


def trace(codes: str, after: list[int], state: int, last: bool) -> tuple[int, str]:
    """State after the chunk and the initials of its least edits, when it is entered in ``state``."""
    costs = [after]
    for code in reversed(codes):
        costs.append(_before(code, costs[-1]))
    costs.reverse()
    out = []
    for i, code in enumerate(codes):
        while True:
            best = costs[i][state]
            fits = [(e, to, True) for e, cost, to in OPTIONS[code][state] if cost + costs[i + 1][to] == best]
            if ADD + costs[i][INSERT[state]] == best:
                fits.append(("I", INSERT[state], False))
            edit, state, done = min(fits)
            out.append(edit)
            if done:
                break
    while last and state not in (0, 3):
        out.append("I")
        state = INSERT[state]
    return state, "".join(out)


def _scaled(costs: list[int]) -> tuple[list[int], int]:
    low = min(costs)
    return [x - low for x in costs], low


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with seeded faults, by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops one, 1 empties it, 2 takes its full
    stops, exclamation and question marks, 3 repeats it, 4 makes it the user's."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = turns.select("conv_id", "turn", "role", "text", (F.crc32(key.cast("binary")) % 20).alias("h")).where("h <> 0")
    rows = rows.withColumn("text", F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("h") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def _group(df: DataFrame) -> F.Column:
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))


def _texts(turns: DataFrame) -> DataFrame:
    """``grp, turn, role, text, mark`` of the turns, nulls replaced."""
    full = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(_group(turns).alias("grp"), "turn", full("role").alias("role"), full("text").alias("text"))
    return rows.withColumn("mark", F.unhex(F.sha2("text", 256)))


def faults(turns: DataFrame) -> DataFrame:
    """``grp, at, n, turn, initial, fault`` of every turn, fault being blank, duplicate, truncated or none."""
    rows = _texts(turns)
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.select("grp", "turn", "role", "mark", (said == "").alias("blank"), (~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("open"))
    rows = placed(rows, "grp", ("turn", "role", "mark"), "turns")
    first = rows.groupBy("grp", "role", "mark").agg(F.min("at").alias("first"))
    rows = rows.join(first, ["grp", "role", "mark"])
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("open"), "truncated")
    initial = F.left("role", F.lit(1))
    return common.written(rows.select("grp", "at", "n", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), fault.alias("fault")), "faults")


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """``grp, chunk, chunks, codes, initials``: a row for each chunk of turns."""
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    each = rows.select("grp", F.expr(f"at div {chunk}").alias("chunk"), F.ceil(F.col("n") / chunk).alias("chunks"), F.struct("at", code.alias("code"), "initial").alias("x"))
    out = each.groupBy("grp", "chunk").agg(F.max("chunks").alias("chunks"), F.sort_array(F.collect_list("x")).alias("x"))
    return out.select("grp", "chunk", "chunks", F.array_join("x.code", "").alias("codes"), F.array_join("x.initial", "").alias("initials"))


VECTORS = "grp string, chunk long, chunks long, codes string, after array<long>, start array<long>, constant long"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with ``new`` run again from it; those without anything from the speculative vector."""
    for b in batches:
        rows = b.to_pylist()
        for r in rows:
            new = r.pop("new")
            if new is None:
                r["after"] = END
                r["start"], r["constant"] = _scaled(costs_at_start(r["codes"], END))
            elif new != r["after"]:
                start = rerun(r["codes"], r["after"], [x + r["constant"] for x in r["start"]], new)
                r["after"] = new
                r["start"], r["constant"] = _scaled(start)
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


_ARROW = pa.schema([("grp", pa.string()), ("chunk", pa.int64()), ("chunks", pa.int64()), ("codes", pa.string()), ("after", pa.list_(pa.int64())), ("start", pa.list_(pa.int64())), ("constant", pa.int64())])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``m``: costs from each state at a chunk's start to each state at its end, row by row."""
    for b in batches:
        m = []
        for codes in b.column("codes").to_pylist():
            columns = [costs_at_start(codes, [0 if s == t else FAR for s in range(4)]) for t in range(4)]
            m.append([min(columns[t][s], FAR) for s in range(4) for t in range(4)])
        yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("chunk"), pa.array(m, pa.list_(pa.int64()))], names=["grp", "chunk", "m"])


def _by_matrices(vectors: DataFrame) -> DataFrame:
    """The vectors of all chunks, from products of the matrices of all that follow, doubling their reach each round."""
    most = vectors.agg(F.max("chunks")).first()[0]
    now, reach = common.written(vectors.select("grp", "chunk", "codes").mapInArrow(_matrices, "grp string, chunk long, m array<long>"), "matrices"), 1
    least = lambda of: F.least(F.lit(FAR), *of)
    while reach < most:
        right = now.select("grp", (F.col("chunk") - reach).alias("chunk"), F.col("m").alias("r"))
        product = F.array(*[least([F.col("m")[4 * s + k] + F.col("r")[4 * k + t] for k in range(4)]) for s in range(4) for t in range(4)])
        new = common.written(now.join(right, ["grp", "chunk"], "left").select("grp", "chunk", F.when(F.col("r").isNull(), F.col("m")).otherwise(product).alias("m")), "matrices")
        common.forget(now)
        now, reach = new, 2 * reach
    start = F.array(*[least([F.col("m")[4 * s + k] + END[k] for k in range(4)]) for s in range(4)])
    low = now.select("grp", (F.col("chunk") - 1).alias("chunk"), start.alias("v")).select("grp", "chunk", F.transform("v", lambda x: x - F.array_min("v")).alias("new"))
    return vectors.join(low, ["grp", "chunk"], "left").select(*vectors.columns, F.coalesce("new", "after").alias("new")).mapInArrow(_run, VECTORS)


def _stitched(chunks: DataFrame, most_passes: int) -> DataFrame:
    """Chunks with the vectors of a whole conversation; see :data:`VECTORS`."""
    speculative = chunks.select("grp", "chunk", "chunks", "codes", *[F.lit(None).cast("array<long>").alias(c) for c in ("after", "start")], F.lit(None).cast("long").alias("constant"), F.lit(None).cast("array<long>").alias("new"))
    first = common.written(speculative.mapInArrow(_run, VECTORS), "vectors")
    whole, now = first.where("chunks = 1"), first.where("chunks > 1")
    for _ in range(most_passes):
        heads = now.select("grp", (F.col("chunk") - 1).alias("chunk"), F.col("start").alias("new"))
        told = now.join(heads, ["grp", "chunk"], "left").withColumn("new", F.coalesce("new", "after"))
        if told.where("new <> after").limit(1).count() == 0:
            break
        now = common.written(told.mapInArrow(_run, VECTORS), "vectors")
    else:
        now = common.written(_by_matrices(now), "vectors")
    return whole.unionByName(now)


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        for r in rows:
            ways = [trace(r["codes"], r["after"], s, r["chunk"] == r["chunks"] - 1) for s in (range(4) if r["chunk"] else range(1))]
            r["exits"], r["audits"] = [w[0] for w in ways], [w[1] for w in ways]
            r["cost"] = r["constant"] + (0 if r["chunk"] else r["start"][0])
        yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("grp", "chunk", "cost", "exits", "audits")} for r in rows], schema=_TRACES)


_TRACES = pa.schema([("grp", pa.string()), ("chunk", pa.int64()), ("cost", pa.int64()), ("exits", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


class _Walk:
    """Follows one conversation: first its chunks, then its turns, both in order."""

    def __init__(self, grp: str):
        self.grp, self.cost, self.state, self.pieces, self.audit, self.place = grp, 0, 0, [], None, 0

    def chunk(self, cost: int, exits: list[int], audits: list[str]) -> None:
        self.cost += cost
        self.pieces.append(audits[self.state])
        self.state = exits[self.state]

    def _ready(self) -> str:
        if self.audit is None:
            self.audit, self.state = "".join(self.pieces), 0
        return self.audit

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """Turns that are added at this place."""
        while self._ready()[self.place : self.place + 1] == "I":
            self.place, self.state = self.place + 1, INSERT[self.state]
            yield "I", ROLE[self.state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of what becomes of a turn, and of what is added before it."""
        yield from self.inserted()
        edit, self.place = self.audit[self.place], self.place + 1
        if edit != "D":
            self.state = MOVES[role[:1]][self.state] if edit == "K" else INSERT[self.state]
            yield edit, role if edit == "K" else ROLE[self.state], text


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Walk, object, Iterator, bool]]:
    """For every turn, and for the end of every conversation: its walk, the turn's number, what comes out, and whether it is the end."""
    walk = None
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("grp", "kind", "turn", "role", "text", "cost", "exits", "audits")]
        for grp, kind, turn, role, text, cost, exits, audits in zip(*columns, strict=True):
            if walk is None or walk.grp != grp:
                if walk is not None:
                    yield walk, None, walk.inserted(), True
                walk = _Walk(grp)
            if kind == 0:
                walk.chunk(cost, exits, audits)
            else:
                yield walk, turn, walk.turn(role, text), False
    if walk is not None:
        yield walk, None, walk.inserted(), True


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("grp", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    done, digest, before = [], hashlib.sha256(), ""
    for walk, _, out, end in _walked(batches):
        for _, role, text in out:
            digest.update(f"{before}{role}:{text}".encode("utf-8", "replace"))
            before = "\n"
        if end:
            done.append({"grp": walk.grp, "cost": walk.cost, "audit": walk.audit, "repaired_sha256": digest.hexdigest()})
            digest, before = hashlib.sha256(), ""
        if len(done) == 1000:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    yield pa.RecordBatch.from_pylist(done, schema=schema)


def _turns_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("grp", pa.string()), ("place", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    done, place = [], 0
    for walk, turn, out, end in _walked(batches):
        for edit, role, text in out:
            done.append({"grp": walk.grp, "place": place, "turn": None if edit == "I" else turn, "edit": edit, "role": role, "text": text})
            place += 1
        place = 0 if end else place
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    yield pa.RecordBatch.from_pylist(done, schema=schema)


def _in_order(turns: DataFrame, rows: DataFrame, chunk: int, most_passes: int) -> DataFrame:
    """Each conversation's traced chunks, then its turns, in order and in one partition."""
    common.ship(turns.sparkSession)
    traces = _stitched(common.written(_chunks(rows, chunk), "chunks"), most_passes).mapInArrow(_traced, "grp string, chunk long, cost long, exits array<long>, audits array<string>")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    one = traces.select("grp", F.lit(0).alias("kind"), "chunk", *none("long", "turn"), *none("string", "role", "text"), *none("binary", "mark"), "cost", "exits", "audits")
    two = _texts(turns).select("grp", F.lit(1).alias("kind"), *none("long", "chunk"), F.col("turn").cast("long").alias("turn"), "role", "text", "mark", *none("long", "cost"), *none("array<long>", "exits"), *none("array<string>", "audits"))
    return one.unionByName(two).repartition("grp").sortWithinPartitions("grp", "kind", "chunk", "turn", "role", "mark")


def repaired(turns: DataFrame, chunk: int = CHUNK, most_passes: int = MOST_PASSES) -> DataFrame:
    """The turns of the repaired conversations: ``conv_id, place, turn, edit, role, text``; added turns have no number."""
    ids = turns.select("conv_id", _group(turns).alias("grp")).distinct()
    out = _in_order(turns, faults(turns), chunk, most_passes).mapInArrow(_turns_out, "grp string, place long, turn long, edit string, role string, text string")
    return out.join(ids, "grp").select("conv_id", "place", "turn", "edit", "role", "text")


def audit(turns: DataFrame, ids: DataFrame | None = None, chunk: int = CHUNK, most_passes: int = MOST_PASSES) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation of ``ids``
    (those of ``turns`` unless given)."""
    ids = (turns if ids is None else ids).select("conv_id").distinct()
    ids = ids.withColumn("grp", _group(ids))
    rows = faults(turns)
    kinds = ("blank", "duplicate", "truncated")
    by_turn = rows.groupBy("grp", "turn").agg(*[F.count_if(F.col("fault") == k).alias(k) for k in kinds])
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = by_turn.groupBy("grp").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *[F.sum(k).alias(k) for k in kinds])
    chunks = _chunks(rows, chunk).select("grp", "chunk", "initials")
    seen = F.concat(F.coalesce(F.lag(F.right("initials", F.lit(1))).over(Window.partitionBy("grp").orderBy("chunk")), F.lit("")), F.col("initials"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("seen") - 1), lambda i: F.substring(F.col("seen"), i, F.lit(2)))
    wrong = F.when(F.length("seen") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    illegal = chunks.select("grp", seen.alias("seen")).groupBy("grp").agg(F.sum(wrong).alias("illegal"))
    told = _in_order(turns, rows, chunk, most_passes).mapInArrow(_digests, "grp string, cost long, audit string, repaired_sha256 string")
    out = ids.join(counts, "grp", "left").join(illegal, "grp", "left").join(told, "grp", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *kinds, "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The same rows in DuckDB SQL: costs to go are carried with their edits and texts, turn by turn from the end."""

    def push(x: str, cost: int, letter: str, row: str) -> str:
        end = f"instr({x}, chr(1))"
        return f"lpad((substr({x}, 1, 8)::BIGINT + {cost})::VARCHAR, 8, '0') || '{letter}' || substr({x}, 9, {end} - 9) || chr(1) || {row} || substr({x}, {end} + 1)"

    def row(role: str) -> str:
        return f"chr(10) || {role} || ':' || text"

    plain = []
    for s in range(4):
        ways = [push(f"b{s}", DELETE, "D", "''")]
        for k, moves in MOVES.items():
            if s in moves:
                b = f"b{moves[s]}"
                ways.append(f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND ini = '{k}' THEN " + f"CASE fault WHEN 'truncated' THEN {push(b, KEEP + TRUNCATED, 'K', row('role'))} ELSE {push(b, KEEP, 'K', row('role'))} END END")
        b, role = f"b{INSERT[s]}", f"'{ROLE[INSERT[s]]}'"
        ways.append(f"CASE WHEN fault = 'truncated' THEN {push(b, REROLE + TRUNCATED, 'R', row(role))} WHEN fault = '' THEN {push(b, REROLE, 'R', row(role))} END")
        plain.append(f"least({', '.join(ways)}) AS p{s}")
    closed = []
    for s in range(4):
        t = INSERT[s]
        added = lambda r: f"chr(10) || '{ROLE[r]}:'"
        closed.append(f"least(p{s}, {push(f'p{t}', ADD, 'I', added(t))}, {push(f'p{INSERT[t]}', 2 * ADD, 'II', f'{added(t)} || {added(INSERT[t])}')}) AS b{s}")
    return f"""WITH RECURSIVE src AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hit AS (SELECT *, {common.crc32_sql('key')} % 20 AS h FROM src),
dam AS (SELECT coalesce('c' || conv_id, '') AS grp, turn, coalesce(CASE h WHEN 4 THEN 'user' ELSE role END, ' ') AS role,
  coalesce(CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END, ' ') AS text FROM hit, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) c(copy)),
pos AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, count(*) OVER (PARTITION BY grp) AS n, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said FROM dam),
told AS (SELECT *, left(role, 1) AS ini, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY grp, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY grp ORDER BY i) AS last FROM pos),
dp AS (SELECT grp, n + 1 AS i, '00000000' || chr(1) AS b0, '00000010II' || chr(1) || chr(10) || 'user:' || chr(10) || 'assistant:' AS b1, '00000005I' || chr(1) || chr(10) || 'assistant:' AS b2, '00000000' || chr(1) AS b3 FROM (SELECT DISTINCT grp, n FROM told)
  UNION ALL SELECT grp, i, {', '.join(closed)} FROM (SELECT dp.grp, t.i, {', '.join(plain)} FROM dp JOIN told t ON t.grp = dp.grp AND t.i = dp.i - 1)),
best AS (SELECT grp, substr(b0, 1, 8)::BIGINT AS cost, substr(b0, 9, instr(b0, chr(1)) - 9) AS audit, substr(b0, instr(b0, chr(1)) + 2) AS repaired FROM dp WHERE i = 1),
counts AS (SELECT grp, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (last IS NOT NULL AND last || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY grp),
ids AS (SELECT DISTINCT conv_id, coalesce('c' || conv_id, '') AS grp FROM conversations)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (grp) LEFT JOIN best USING (grp)"""


ORACLE_SQL = _sql()
