"""Repair of conversation structure by iterative-deepening A*.

A conversation is in order when the initials of its roles read ``(s?(ua)+)?`` and no row is blank, a duplicate or cut
off. Rows may be kept (0), given the role user or assistant (1) or deleted (2; the only edit of blank and duplicate
rows), and empty rows of user or assistant may be inserted anywhere (5); a cut-off row that stays costs 5 more. The
cheapest edits are found depth first in the order of their initials (D, I, K, R) under a bound on the cost. When no
path is left, the bound rises to the least cost that exceeded it. A table of failed states keeps what each state is
known to cost at least, so a state that failed is entered again only when the bound has outgrown that. The first
accepted path is the answer, of the cheapest the one whose initials come first.

Conversations of usual size are searched whole, one per row of a grouped table. Longer ones are never gathered: their
rows are put in order in ranges and cut into segments of at most ``SEGMENT`` rows. For each segment the search gives
the least cost from any state to any other; a scan over these small tables (16 numbers per segment) tells each segment
what every state costs from there on; then the segments are searched with these costs at their ends, from each state,
and a second scan picks the state in which each is entered. Initials determine the states they lead to and inserts stand
before the row they precede, so the segments' first cheapest paths, one after another, are the first cheapest path.

Nulls count as one space (a turn of null comes first). Rows of one turn are ordered by role, then by the SHA-256 of their
text; an empty role has no legal initial. Exact copies of a row are duplicates. Empty conversations give zeros. Other
columns of the table may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.llm.common import BLANKS, col
from weirworks.llm.places import AT, in_order, never_null
from weirworks.session import cut_lineage

# States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ANSWERED = range(4)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ANSWERED: USER}, "a": {USER: ANSWERED}}
DELETE, INSERT, KEEP, REROLE, CUT_OFF = 2, 5, 0, 1, 5
NEVER = 1 << 60
ROLES = ("user", "assistant")
# Rows and bytes up to which a conversation is one group, and rows of a segment of a longer one.
WHOLE_ROWS, WHOLE_BYTES, SEGMENT = 128, 8 << 20, 64
LEGAL = ("su", "ua", "au")


def fitting(state: int) -> int:
    """The state that a user or assistant row leads to, whichever of them is legal here."""
    return ANSWERED if state == USER else USER


def least_costs(codes: str) -> list[int]:
    """For each place what the rows from there on cost at least, each taken by itself."""
    out = [0]
    for c in reversed(codes):
        out.append(out[-1] + (DELETE if c in "bd" or c.isupper() else 0 if c in AFTER else REROLE))
    return out[::-1]


def cheapest(codes: str, start: int, finish: Sequence[int], open_end: bool) -> tuple[int, str, int] | None:
    """Cost, initials of the edits and last state of the first cheapest path, or None if there is none.

    ``codes`` has a letter per row: s, u, a, or o for another initial, in capitals if cut off; b blank, d duplicate.
    ``finish`` is what is added in each last state (NEVER: not accepted). Inserts after the last row need ``open_end``.
    """
    n, least, end = len(codes), least_costs(codes), min(finish)
    known: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def steps(at: int, state: int):
        row = codes[at] if at < n else ""
        more = CUT_OFF if row.isupper() else 0
        if row:
            yield "D", DELETE, at + 1, state
        if row or open_end:
            yield "I", INSERT, at, fitting(state)
        if row and row not in "bd":
            then = AFTER.get(row.lower(), {}).get(state)
            if then is not None:
                yield "K", KEEP + more, at + 1, then
            yield "R", REROLE + more, at + 1, fitting(state)

    def search(at: int, state: int, left: int) -> int | None:
        """The last state of an accepted path within ``left``; None, with a higher known cost, if there is none."""
        if at == n and finish[state] <= left:
            return state
        dearer = finish[state] if at == n else NEVER
        for letter, cost, then, to in steps(at, state):
            here = known.get((then, to), least[then] + end)
            if here <= left - cost:
                path.append(letter)
                found = search(then, to, left - cost)
                if found is not None:
                    return found
                path.pop()
                here = known[then, to]
            dearer = min(dearer, here + cost)
        known[at, state] = max(dearer, left + 1)
        return None

    # Whatever can be reached is reached by deleting all rows and two inserts, or keeping one row of the system.
    bound, most = least[0] + end, DELETE * n + 2 * INSERT + end
    while bound <= most + (max((f for f in finish if f < NEVER), default=0) - end):
        last = search(0, start, bound)
        if last is not None:
            return bound, "".join(path), last
        bound = known[0, start]
    return None


def illegal_pairs(initials: str) -> int:
    return sum(initials[n : n + 2] not in LEGAL for n in range(len(initials) - 1))


def applied(codes: str, edits: str, state: int) -> Iterator[tuple[int, list[str], str | None]]:
    """For each row its number, the roles inserted before it, and its new role ('' as it was, None deleted).

    Inserts after the last row come with the number after it.
    """
    at, before = 0, []
    for letter in edits:
        role = ROLES[fitting(state) == ANSWERED]
        if letter == "I":
            before.append(role)
            state = fitting(state)
            continue
        if letter == "D":
            new = None
        else:
            new = "" if letter == "K" else role
            state = AFTER[codes[at].lower()][state] if letter == "K" else fitting(state)
        yield at, before, new
        at, before = at + 1, []
    if before:
        yield at, before, None


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text) with the faults that a hash of conversation and turn deals out.

    Of 20 remainders 0 drops a row, 1 empties its text, 2 takes its ends of sentences, 3 repeats it, 4 makes it the user's.
    """

    def shown(name: str) -> Column:
        return F.coalesce(col(rows, name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn))) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.translate(shown(text), ".!?", "")).otherwise(shown(text))
    out = rows.where(kind != 0).select(
        col(rows, conv).alias("conv"),
        col(rows, turn).alias("turn"),
        F.when(kind == 4, "user").otherwise(shown(role)).alias("role"),
        body.alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return out.drop("copy")


def _marked(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    conv, turn, role, text = names
    rows = rows.select(
        never_null(col(rows, conv)).alias("key"),
        col(rows, turn).alias("turn"),
        F.coalesce(col(rows, role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(col(rows, text).cast("string"), F.lit(" ")).alias("text"),
    )
    body, first = F.rtrim(F.col("text"), F.lit(BLANKS)), F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    whole = F.substring(body, -1, 1).isin(".", "!", "?")
    code = F.when(body == "", "b").when(whole, initial).otherwise(F.upper(initial))
    return rows.withColumn("initial", initial).withColumn("code", code).withColumn("tie", F.sha2("text", 256))


REPORT = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _lines(role: str, text: str, before: Sequence[str], new: str | None) -> list[str]:
    return [f"{r}:" for r in before] + ([] if new is None else [f"{new or role}:{text}"])


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations gathered in one row each."""
    for batch in batches:
        out = []
        for key, rows in zip(batch["key"], batch["rows"], strict=True):
            seen, codes = set(), ""
            for r in rows:
                said = (r["role"], r["tie"])
                codes += "d" if r["code"] != "b" and said in seen else r["code"]
                seen.add(said)
            cost, audit, _ = cheapest(codes, START, (0, NEVER, NEVER, 0), True)
            lines = []
            for at, before, new in applied(codes, audit, START):
                r = rows[at] if at < len(rows) else {"role": "", "text": ""}
                lines += _lines(r["role"], r["text"], before, new)
            sha = hashlib.sha256("\n".join(lines).encode("utf-8", "replace")).hexdigest()
            illegal = illegal_pairs("".join(r["initial"] for r in rows))
            out.append((key, codes.count("b"), codes.count("d"), sum(map(str.isupper, codes)), illegal, cost, audit, sha))
        yield pd.DataFrame(out, columns=["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


def _segment_costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Least cost from each state to each (16 numbers), for a segment that others follow and for one that is the last."""
    for batch in batches:
        out = []
        for key, seg, codes, initials in zip(batch["key"], batch["seg"], batch["codes"], batch["initials"], strict=True):
            costs = []
            for start in range(4):
                for stop in range(4):
                    found = None
                    if stop in (USER, ANSWERED) or start == stop or (start, stop) == (START, SYSTEM) and "s" in codes.lower():
                        found = cheapest(codes, start, [0 if s == stop else NEVER for s in range(4)], False)
                    costs.append(found[0] if found else NEVER)
            out.append((key, seg, costs, illegal_pairs(initials), initials[0], initials[-1]))
        yield pd.DataFrame(out, columns=["key", "seg", "costs", "illegal", "head", "tail"])


def _costs_to_go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each segment what every state costs behind it, from the last segment to the first."""
    for batch in batches:
        for key, segments in zip(batch["key"], batch["segments"], strict=True):
            illegal = sum(s["illegal"] for s in segments) + sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(segments, segments[1:], strict=False))
            # Behind the last row only inserts are left: none where the path may end, two after system, one after user.
            ahead, out = [0, 2 * INSERT, INSERT, 0], []
            for s in segments[::-1]:
                out.append((s["seg"], ahead))
                ahead = [min(s["costs"][4 * a + b] + ahead[b] for b in range(4)) for a in range(4)]
            last = segments[-1]["seg"]
            rows = [(key, seg, togo, seg == last, illegal, ahead[START]) for seg, togo in out]
            yield pd.DataFrame(rows, columns=["key", "seg", "ahead", "last", "illegal", "cost"])


def _segment_edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edits of a segment, and the state they end in, for each state in which it may be entered."""
    for batch in batches:
        edits, stops = [], []
        for codes, ahead, last in zip(batch["codes"], batch["ahead"], batch["last"], strict=True):
            finish = (0, NEVER, NEVER, 0) if last else [int(a) for a in ahead]
            found = [cheapest(codes, start, finish, bool(last)) for start in range(4)]
            edits.append([f[1] if f else "" for f in found])
            stops.append([f[2] if f else start for start, f in enumerate(found)])
        yield batch[["key", "seg", "first", "codes"]].assign(edits=edits, stops=stops)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state in which each segment is entered, from the first to the last."""
    for batch in batches:
        for key, segments in zip(batch["key"], batch["segments"], strict=True):
            state, out = START, []
            for s in segments:
                out.append((key, s["seg"], state))
                state = int(s["stops"][state])
            yield pd.DataFrame(out, columns=["key", "seg", "entry"])


def _row_edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples():
            rows = [(r.key, r.first + min(at, len(r.codes) - 1), at == len(r.codes), before, new) for at, before, new in applied(r.codes, r.audit, r.entry)]
            yield pd.DataFrame(rows, columns=["key", AT, "after", "before", "new"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's lines, which pass by in order and are not held."""
    held, sha = None, None
    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])

    def told():
        return pa.RecordBatch.from_pylist([{"key": held, "repaired_sha256": sha.hexdigest()}], schema)

    for batch in batches:
        for key, line in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if key != held:
                if sha is not None:
                    yield told()
                held, sha = key, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(line.encode("utf-8", "replace"))
    if sha is not None:
        yield told()


def _long(rows: DataFrame) -> DataFrame:
    """The report on conversations that are not gathered."""
    held = in_order(rows, ["key", "turn", "role", "tie"])
    firsts = held.groupBy("key", "role", "tie").agg(F.min(AT).alias(AT)).select(AT, F.lit(True).alias("is_first"))
    code = F.when((F.col("code") != "b") & F.col("is_first").isNull(), "d").otherwise(F.col("code"))
    coded = held.select("key", AT, "code", "initial").join(firsts, AT, "left").withColumn("code", code)
    inside = F.sort_array(F.collect_list(F.struct(AT, "code", "initial")))
    segments = coded.groupBy("key", F.shiftright(AT, (SEGMENT - 1).bit_length()).alias("seg")).agg(F.min(AT).alias("first"), inside.alias("r"))
    segments = segments.select("key", "seg", "first", F.array_join("r.code", "").alias("codes"), F.array_join("r.initial", "").alias("initials"))
    segments = cut_lineage(segments)

    costs = segments.mapInPandas(_segment_costs, "key string, seg long, costs array<long>, illegal long, head string, tail string")
    gathered = F.sort_array(F.collect_list(F.struct("seg", "costs", "illegal", "head", "tail"))).alias("segments")
    ahead = costs.groupBy("key").agg(gathered).mapInPandas(_costs_to_go, "key string, seg long, ahead array<long>, last boolean, illegal long, cost long")
    ahead = cut_lineage(ahead)

    found = segments.join(ahead, ["key", "seg"]).select("key", "seg", "first", "codes", "ahead", "last")
    found = cut_lineage(found.mapInPandas(_segment_edits, "key string, seg long, first long, codes string, edits array<string>, stops array<int>"))
    entries = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seg", "stops"))).alias("segments"))
    entries = entries.mapInPandas(_entries, "key string, seg long, entry int")
    audit = F.get("edits", F.col("entry")).alias("audit")
    chosen = cut_lineage(found.join(entries, ["key", "seg"]).select("key", "seg", "first", "codes", "entry", audit))

    edits = chosen.mapInPandas(_row_edits, f"key string, {AT} long, after boolean, before array<string>, new string")
    edits = edits.where(F.col("new").isNotNull() | (F.size("before") > 0))
    texts = held.select(F.col(AT).alias("text_at"), "role", "text")
    both = edits.join(texts, (F.col(AT) == F.col("text_at")) & ~F.col("after"), "left")
    added = F.transform("before", lambda r: F.concat(r, F.lit(":")))
    own = F.when(F.col("new").isNull(), F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.when(F.col("new") == "", F.col("role")).otherwise(F.col("new")), F.lit(":"), F.col("text")))
    )
    lines = both.select("key", AT, "after", F.array_join(F.concat(added, own), "\n").alias("line"))
    lines = lines.repartition("key").sortWithinPartitions("key", AT, "after").select("key", "line")
    shas = lines.mapInArrow(_digests, "key string, repaired_sha256 string")

    def count(letters: str) -> Column:
        return F.sum(F.length("codes") - F.length(F.translate("codes", letters, "")))

    told = chosen.groupBy("key").agg(
        count("b").alias("blank"),
        count("d").alias("duplicate"),
        count("SUAO").alias("truncated"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda s: s["audit"]), "").alias("audit"),
    )
    totals = ahead.where("last").select("key", "illegal", "cost")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = told.join(totals, "key").join(shas, "key", "left")
    return out.select("key", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def repair(rows: DataFrame, conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One report per conversation of ``conversations`` (column ``conv``) on its ``rows``.

    conv, gaps (turns missing between the first and the last), blank, duplicate, truncated, illegal (neighbouring roles
    out of order), cost, audit (initials of the edits) and repaired_sha256 of the repaired rows, ``role:text`` by lines.
    """
    marked = _marked(rows, (conv, turn, role, text))
    sizes = marked.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
    )
    sizes = cut_lineage(sizes)
    large = sizes.where((F.col("n") > WHOLE_ROWS) | (F.col("bytes") > WHOLE_BYTES)).select("key")
    usual = marked.join(large, "key", "left_anti")
    gathered = F.sort_array(F.collect_list(F.struct("turn", "role", "tie", "text", "code", "initial")))
    usual = usual.groupBy("key").agg(F.transform(gathered, lambda r: r.dropFields("turn")).alias("rows"))
    reports = usual.mapInPandas(_whole, REPORT)
    if not large.isEmpty():
        reports = reports.unionByName(_long(marked.join(large, "key", "left_semi")))
    every = conversations.select(never_null(col(conversations, conv)).alias("key"), col(conversations, conv).alias(conv))
    every = every.groupBy("key").agg(F.first(conv).alias(conv))
    out = every.join(sizes.select("key", "gaps"), "key", "left").join(reports, "key", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(conv, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
