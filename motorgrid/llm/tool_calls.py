"""Tool-call linking, all in DataFrame operations.

Calls and results meet in a hash join on (conversation, call id). Calls are ordered so that each comes
after those it depends on, their arguments are checked against the schema of the tool, and each call is
written as one canonical JSON object: sorted keys, no spaces, at every depth. The unit is a call, for
the order a block of up to 1,024 call ids, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorgrid.llm.common import settle
from motorgrid.operators.skew import running_total

# Tool -> argument -> (JSON type, is required). Types: string, integer, number, boolean, array, object.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
KEY = ["conv_id", "call_id"]
# Turns of one bucket when positions are counted.
BUCKET_TURNS = 256
# Calls of one block when levels are found; a block is one row.
BLOCK_CALLS = 1024
_NOT_NULL = {"ignoreNullFields": "false"}


def json_type(value: Column) -> Column:
    """JSON type of a variant; null where there is no value."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None).when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
        .when(kind == "BIGINT", "integer").when(kind.rlike(r"^DECIMAL\([0-9]+,0\)$"), "integer")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
        .otherwise("null"))


def argument_errors(tool: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted array of what is wrong with a call; empty if nothing is."""
    parsed = F.try_parse_json(arguments)
    kind = json_type(parsed)
    cases = F.when(kind.isNull(), F.array(F.lit("arguments: not JSON"))).when(
        kind != "object", F.array(F.lit("arguments: not an object")))
    for name, fields in schemas.items():
        found = []
        for field, (wanted, required) in fields.items():
            value = F.try_variant_get(parsed, f"$['{field}']", "variant")
            has = json_type(value)
            fits = (has == wanted) | (F.lit(wanted == "number") & (has == "integer"))
            found.append(F.when(
                has.isNull(), F.lit(f"{field}: missing") if required else None).when(
                ~fits, F.lit(f"{field}: not {wanted}")))
        extra = F.transform(
            F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(f) for f in fields])),
            lambda k: F.concat(k, F.lit(": unknown")))
        listed = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
        cases = cases.when(tool == name, F.array_sort(F.concat(
            listed, F.coalesce(extra, F.array().cast("array<string>")))))
    return cases.otherwise(F.array(F.lit("tool: unknown")))


def dependencies(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, needs, backward): each dependency of each call.

    ``needs`` is null where it is no call of the conversation; ``backward`` tells whether it stands
    before the call by (turn, call_id).
    """
    named = calls.where("call_id is not null")
    wanted = named.select(*KEY, "turn", F.explode(F.array_distinct("depends_on")).alias("needs"))
    there = named.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"),
                         F.col("turn").alias("_t"))
    place = F.struct(F.col("turn"), F.col("call_id"))
    return wanted.join(
        there.hint("shuffle_hash"),
        wanted["conv_id"].eqNullSafe(there["_c"]) & (wanted["needs"] == there["_i"]), "left",
    ).select(*KEY, F.when(F.col("_i").isNotNull(), F.col("needs")).alias("needs"),
             F.coalesce(F.struct(F.col("_t").alias("turn"), F.col("_i").alias("call_id")) < place,
                        F.lit(False)).alias("backward"))


def _solved(items: Column) -> Column:
    """Level of each of the calls of a block (struct base, waiting, inner; in order), -1 where it is open.

    A pass goes through the calls in order and closes those whose ``inner`` (places in the block) are
    closed. Passes follow until one closes nothing: one where all point back, and one more for each
    turn of direction along a chain.
    """
    open_ = F.lit(-1).cast("long")

    def passed(before: Column) -> Column:
        def closed(done: Column, i: Column) -> Column:
            item = F.get(items, i)
            below = F.transform(item["inner"], lambda k: F.when(
                k < i, F.get(done, k)).otherwise(F.get(before, k)))
            waits = (item["waiting"] > 0) | F.coalesce(F.array_min(below) < 0, F.lit(False))
            level = F.when(F.get(before, i) >= 0, F.get(before, i)).when(waits, open_).otherwise(
                F.greatest(item["base"], F.coalesce(F.array_max(below) + 1, F.lit(0).cast("long"))))
            return F.concat(done, F.array(level))

        return F.aggregate(F.sequence(F.lit(0), F.size(items) - 1),
                           F.array().cast("array<bigint>"), closed)

    def again(state: Column, _: Column) -> Column:
        # A one-element array holds the pass, so that it is not worked out twice.
        return F.when(state["last"] == state["now"], state).otherwise(F.get(F.transform(
            F.array(passed(state["now"])),
            lambda x: F.struct(state["now"].alias("last"), x.alias("now"))), F.lit(0)))

    first = F.struct(F.array().cast("array<bigint>").alias("last"),
                     F.transform(items, lambda _: open_).alias("now"))
    return F.aggregate(F.sequence(F.lit(0), F.size(items)), first, again)["now"]


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): longest chain of dependencies below each of ``calls``.

    ``calls``: conv_id, call_id, turn; ``edges``: conv_id, call_id, needs. A call on or behind a cycle
    has a null level. A conversation is cut into blocks of BLOCK_CALLS calls by turn; a round closes
    in every block all that the levels known outside allow. A conversation of one block takes one
    round whatever its turns and dependencies, a longer one a round per change of block along a chain.
    """
    spot = ["conv_id", "block", "at"]
    placed = running_total(
        calls.select(*KEY, "turn"), ["conv_id"], ["turn", "call_id"],
        F.floor(F.col("turn") / BUCKET_TURNS), F.lit(1), "_n")
    placed = settle(placed.select(
        *KEY, F.floor(F.col("_n") / BLOCK_CALLS).cast("long").alias("block"),
        (F.col("_n") % BLOCK_CALLS).cast("int").alias("at")), "places")
    target = placed.withColumnsRenamed({"call_id": "needs", "block": "_block", "at": "_at"})
    target = target.withColumnRenamed("conv_id", "_tc").withColumnRenamed("needs", "_tn")
    ends = _by_key(edges.select(*KEY, "needs"), placed)
    ends = settle(ends.join(
        target.hint("shuffle_hash"), ends["conv_id"].eqNullSafe(target["_tc"])
        & (ends["needs"] == target["_tn"])).select(*KEY, "block", "at", "_block", "_at"), "ends")
    inner = ends.where("block = _block").groupBy(*KEY).agg(F.collect_set("_at").alias("inner"))
    across = ends.where("block <> _block")
    zero = F.lit(0).cast("long")
    own = settle(_by_key(placed, inner).withColumn(
        "inner", F.coalesce("inner", F.array().cast("array<int>"))), "own")
    many = bool(across.take(1))
    state = own.select("*", zero.alias("base"), zero.alias("waiting"))
    if many:
        waits = across.groupBy(*KEY).agg(F.count("*").alias("waiting"))
        state = _by_key(own, waits).withColumns({
            "base": zero, "waiting": F.coalesce("waiting", zero)})
    last = -1
    while True:
        blocks = settle(state.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(
            F.struct("at", "call_id", "base", "waiting", "inner"))).alias("items")), "blocks")
        found = settle(blocks.select(*spot[:2], F.explode(F.arrays_zip(
            "items", _solved(F.col("items")).alias("level"))).alias("x")).select(
            *spot[:2], F.col("x.items.at").alias("at"), F.col("x.items.call_id").alias("call_id"),
            F.nullif(F.col("x.level"), F.lit(-1).cast("long")).alias("level")), "levels")
        if not many:
            break
        done = found.where("level is not null").count()
        if done == last:
            break
        last = done
        known = found.select(F.col("conv_id").alias("_fc"), F.col("block").alias("_fb"),
                             F.col("at").alias("_fa"), "level")
        met = across.join(
            known.hint("shuffle_hash"), across["conv_id"].eqNullSafe(known["_fc"])
            & (across["_block"] == known["_fb"]) & (across["_at"] == known["_fa"]))
        outer = met.groupBy(*KEY).agg(
            F.max(F.col("level") + 1).alias("base"), F.count_if(F.col("level").isNull()).alias("waiting"))
        state = _by_key(own, outer).withColumns({
            "base": F.coalesce("base", zero), "waiting": F.coalesce("waiting", zero)})
    return found.select(*KEY, "level")


def ordered(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, missing): level of every named call, and its dependencies that are no
    calls of the conversation."""
    needed = settle(dependencies(calls), "dependencies")
    missing = needed.where("needs is null").groupBy(*KEY).agg(F.count("*").alias("missing"))
    return _by_key(levels(calls.where("call_id is not null"), needed.where("needs is not null")),
                   missing).select(*KEY, "level", F.coalesce("missing", F.lit(0)).alias("missing"))


def ranks(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, rank, missing): calls in order of (rank, turn, call_id) come after all that
    they depend on. Not used by ``link_calls``, which orders every conversation by level.

    Where every dependency of a conversation points back, its turns are in order already and all ranks
    are 0. The calls of other conversations take their level as rank, null on or behind a cycle.
    """
    needed = settle(dependencies(calls), "dependencies")
    missing = needed.where("needs is null").groupBy(*KEY).agg(F.count("*").alias("missing"))
    mixed = needed.where("needs is not null and not backward").select(
        F.col("conv_id").alias("_mixed")).distinct()
    named = calls.where("call_id is not null")

    def of_mixed(rows: DataFrame, how: str) -> DataFrame:
        return rows.join(mixed.hint("merge"), rows["conv_id"].eqNullSafe(mixed["_mixed"]), how)

    plain = of_mixed(named, "left_anti").select(*KEY, F.lit(0).cast("long").alias("rank"))
    rest = levels(of_mixed(named, "left_semi"), of_mixed(
        needed.where("needs is not null"), "left_semi")).withColumnRenamed("level", "rank")
    return _by_key(plain.unionByName(rest), missing).select(
        *KEY, "rank", F.coalesce("missing", F.lit(0)).alias("missing"))


def _by_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the null-safe key, with the columns of ``right`` beside."""
    r = right.withColumnsRenamed({"conv_id": "_rc", "call_id": "_ri"})
    return left.join(r.hint("shuffle_hash"), left["conv_id"].eqNullSafe(r["_rc"])
                     & left["call_id"].eqNullSafe(r["_ri"]), "left").drop("_rc", "_ri")


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call, and per result without a call.

    ``calls``: conv_id, call_id, turn, tool, arguments (JSON), depends_on (ids of the conversation);
    ``results``: conv_id, call_id, turn, content. Of calls or results that share conversation and id
    the first counts, by turn and then by content; ``copies`` says how many there were. Calls without
    an id cannot be linked or depended on; those of a conversation count as one.

    Returns conv_id, call_id, position (topological, from 0 in each conversation; null for lone
    results and cycles), level, status ('ok', 'no result', 'cycle', 'no call'), errors, copies and
    linked (canonical JSON). Empty tables give no rows; other columns are not looked at.
    """
    one_call = calls.groupBy(*KEY).agg(
        F.min_by(F.struct("turn", "tool", "arguments", "depends_on"),
                 F.struct("turn", "tool", "arguments")).alias("c"),
        F.count("*").alias("copies")).select(*KEY, "c.*", "copies")
    one_call = settle(one_call, "calls")
    one_result = results.groupBy(*KEY).agg(
        F.min_by("content", F.struct("turn", "content")).alias("content"),
        F.count("*").alias("result_copies"))
    answers = one_result.where("call_id is not null").select(
        *KEY, F.struct("content").alias("answer"))
    linked = _by_key(_by_key(one_call, answers), ordered(one_call))
    status = F.when(F.col("level").isNull() & F.col("call_id").isNotNull(), "cycle").when(
        F.col("answer").isNull(), "no result").otherwise("ok")
    level = F.when(F.col("call_id").isNull(), 0).otherwise(F.col("level"))
    errors = F.concat(
        argument_errors(F.col("tool"), F.col("arguments"), schemas),
        F.when(F.col("missing") > 0, F.array(F.lit("depends_on: missing"))).otherwise(
            F.array().cast("array<string>")))
    staged = linked.withColumns({"status": status, "level": level, "errors": errors})
    staged = settle(staged.select(
        *KEY, "turn", "level", "status", F.array_join("errors", "; ").alias("errors"), "copies",
        F.to_json(F.struct(
            F.try_parse_json("arguments").alias("arguments"), "call_id",
            F.array_sort(F.array_distinct("depends_on")).alias("depends_on"),
            F.col("answer.content").alias("result"), "tool"), _NOT_NULL).alias("linked")), "linked")
    placed = running_total(
        staged.where("level is not null"), ["conv_id"], ["level", "turn", "call_id"],
        F.struct("level", F.floor(F.col("turn") / BUCKET_TURNS).alias("t")), F.lit(1), "position")
    columns = [*KEY, F.col("position").cast("long").alias("position"),
               F.col("level").cast("long").alias("level"), "status", "errors", "copies", "linked"]
    cyclic = staged.where("level is null").withColumn("position", F.lit(None))
    known = one_call.where("call_id is not null").select(*KEY).withColumnsRenamed(
        {"conv_id": "_rc", "call_id": "_ri"})
    alone = one_result.join(
        known.hint("shuffle_hash"), one_result["conv_id"].eqNullSafe(known["_rc"])
        & (one_result["call_id"] == known["_ri"]), "left_anti").select(
        *KEY, F.lit(None).cast("long").alias("position"), F.lit(None).cast("long").alias("level"),
        F.lit("no call").alias("status"), F.lit("").alias("errors"),
        F.col("result_copies").alias("copies"),
        F.to_json(F.struct("call_id", F.col("content").alias("result")), _NOT_NULL).alias("linked"))
    return placed.select(*columns).unionByName(cyclic.select(*columns)).unionByName(alone)


# Tools of the calls that ``calls_of`` reads out of plain conversations.
TOOLS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "lookup": {"key": ("string", True), "fields": ("array", False)},
    "write": {"text": ("string", True), "append": ("boolean", False)},
}


def calls_of(conversations: DataFrame) -> DataFrame:
    """Calls for conversations that have none of their own: each assistant turn is one.

    The tool follows from conv_id, the arguments hold the turn's text, some of them are malformed by
    the length of the text. A call depends on the assistant turn before it, in every other
    conversation also on the one before that.
    """
    length, turn, conv = F.length("text"), F.col("turn"), F.col("conv_id")
    name = lambda back: F.concat(F.lit("c"), conv, F.lit("-"), turn - back)
    search = F.when(length % 5 == 0, F.to_json(F.struct(
        F.col("text").alias("query"), turn.cast("string").alias("limit")))).otherwise(
        F.to_json(F.struct(F.col("text").alias("query"), turn.alias("limit"))))
    lookup = F.to_json(F.struct(
        F.array(F.lit("a"), turn.cast("string")).alias("fields"),
        F.when(length % 7 != 0, F.concat(F.lit("k"), conv)).alias("key")))
    write = F.to_json(F.struct(
        F.col("text").alias("text"), (turn > 2).alias("append"),
        F.when(length % 11 == 0, F.lit("x")).alias("mode")))
    kind = F.pmod(conv, F.lit(3))
    return conversations.where("role = 'assistant'").select(
        "conv_id", name(0).alias("call_id"), "turn",
        F.when(kind == 0, "search").when(kind == 1, "lookup").otherwise("write").alias("tool"),
        F.when(kind == 0, search).when(kind == 1, lookup).otherwise(write).alias("arguments"),
        F.array_compact(F.array(
            F.when(turn >= 3, name(2)), F.when((turn >= 5) & (conv % 2 == 0), name(4)))
        ).alias("depends_on"))


def results_of(conversations: DataFrame) -> DataFrame:
    """Each user turn after the first is the result of the call of the turn before it."""
    return conversations.where("role = 'user' and turn > 0").select(
        "conv_id", F.concat(F.lit("c"), "conv_id", F.lit("-"), F.col("turn") - 1).alias("call_id"),
        "turn", F.col("text").alias("content"))


def linked_conversations(conversations: DataFrame) -> DataFrame:
    return link_calls(calls_of(conversations), results_of(conversations), TOOLS)


SQL = """
WITH RECURSIVE a AS (
    SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id, text, length(text) AS n,
        conv_id % 3 AS k,
        list_filter([CASE WHEN turn >= 3 THEN 'c' || conv_id || '-' || (turn - 2) END,
            CASE WHEN turn >= 5 AND conv_id % 2 = 0 THEN 'c' || conv_id || '-' || (turn - 4) END],
            lambda x: x IS NOT NULL) AS needs
    FROM conversations WHERE role = 'assistant'),
r AS (
    SELECT conv_id, 'c' || conv_id || '-' || (turn - 1) AS call_id, text AS content
    FROM conversations WHERE role = 'user' AND turn > 0),
e AS (
    SELECT a.conv_id, a.call_id, p.call_id AS needs, u.x
    FROM a, unnest(a.needs) AS u(x) LEFT JOIN a AS p ON p.conv_id = a.conv_id AND p.call_id = u.x),
paths AS (
    SELECT conv_id, call_id, 0 AS level FROM a
    UNION
    SELECT e.conv_id, e.call_id, paths.level + 1 FROM e JOIN paths
        ON e.conv_id = paths.conv_id AND e.needs = paths.call_id),
l AS (SELECT conv_id, call_id, max(level) AS level FROM paths GROUP BY ALL),
m AS (SELECT conv_id, call_id, count(*) FILTER (needs IS NULL) AS missing FROM e GROUP BY ALL),
c AS (
    SELECT a.*, l.level, r.content, r.call_id IS NOT NULL AS answered,
        CASE k WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'write' END AS tool,
        CASE WHEN k = 0 AND n % 5 = 0 THEN 'limit: not integer'
             WHEN k = 1 AND n % 7 = 0 THEN 'key: missing'
             WHEN k = 2 AND n % 11 = 0 THEN 'mode: unknown' END AS wrong,
        CASE WHEN coalesce(m.missing, 0) > 0 THEN 'depends_on: missing' END AS lost,
        CASE WHEN k = 0 AND n % 5 = 0 THEN json_object('limit', turn::VARCHAR, 'query', text)
             WHEN k = 0 THEN json_object('limit', turn, 'query', text)
             WHEN k = 1 AND n % 7 = 0 THEN json_object('fields', ['a', turn::VARCHAR])
             WHEN k = 1 THEN json_object('fields', ['a', turn::VARCHAR], 'key', 'k' || conv_id)
             WHEN n % 11 = 0 THEN json_object('append', turn > 2, 'mode', 'x', 'text', text)
             ELSE json_object('append', turn > 2, 'text', text) END AS args
    FROM a JOIN l USING (conv_id, call_id) LEFT JOIN m USING (conv_id, call_id)
    LEFT JOIN r USING (conv_id, call_id))
SELECT conv_id, call_id,
    row_number() OVER (PARTITION BY conv_id ORDER BY level, turn, call_id) - 1 AS position,
    level::BIGINT AS level, CASE WHEN answered THEN 'ok' ELSE 'no result' END AS status,
    concat_ws('; ', wrong, lost) AS errors, 1::BIGINT AS copies,
    json_object('arguments', args, 'call_id', call_id, 'depends_on', list_sort(needs),
        'result', content, 'tool', tool)::VARCHAR AS linked
FROM c
UNION ALL
SELECT conv_id, call_id, NULL, NULL, 'no call', '', 1,
    json_object('call_id', call_id, 'result', content)::VARCHAR
FROM r WHERE call_id NOT IN (SELECT call_id FROM a)
"""
