"""Free SQL over the nine tables: what is accepted, and how PostgreSQL spellings become Spark's.

A statement runs in a session of its own whose only relations are the nine tables, so the caller's temporary views are neither
read nor replaced. It is accepted if Spark parses it as one query, every relation in it is one of the nine
tables (bare, or qualified by the schema's name) or a common table expression of its own, and every function it
calls is on the list below. So path tables, table functions and calls into the JVM are refused before
anything runs.

Three PostgreSQL spellings are rewritten token by token, outside of strings and comments: ``schema.table`` becomes
``table``; a cast to ``numeric`` or ``decimal`` without precision keeps its decimals; types that Spark names differently
(``text``, ``int8``, ``double precision``) get Spark's name, in ``::`` and in ``CAST``.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfwise.sources.schema import TABLE_NAMES

#: Name by which statements may qualify the nine tables.
SCHEMA = "retail"

# PostgreSQL's type names and Spark's.
TYPES = {
    "numeric": "decimal(38,10)", "decimal": "decimal(38,10)", "text": "string", "varchar": "string", "bpchar": "string",
    "character varying": "string", "int2": "smallint", "int4": "int", "int8": "bigint", "float4": "float", "float8": "double",
    "double precision": "double", "bool": "boolean", "timestamptz": "timestamp",
}

# Functions that a statement may call.
FUNCTIONS = frozenset("""
abs any_value approx_count_distinct approx_percentile array_agg ascii avg bool_and bool_or btrim cardinality ceil ceiling char_length
character_length chr coalesce collect_list collect_set concat concat_ws contains corr count count_if covar_pop covar_samp cume_dist
current_date current_timestamp date date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek
dayofyear decode dense_rank div endswith every exp extract first first_value float floor format_number get_json_object greatest
hour if ifnull initcap instr isnan isnotnull isnull json_object_keys lag last last_day last_value lcase lead least left len length listagg ln
locate log log10 log2 lower lpad ltrim make_date max max_by mean median min min_by minute mod mode month months_between next_day
now nth_value ntile nullif nvl nvl2 overlay percent_rank percentile percentile_approx percentile_cont percentile_disc pmod
position pow power quarter rank regexp_count regexp_extract regexp_like regexp_replace repeat replace reverse right rlike round row_number
rpad rtrim second sign signum some split split_part sqrt startswith std stddev stddev_pop stddev_samp string_agg substr substring
sum to_char to_date to_number to_timestamp translate trim trunc try_divide try_to_number ucase upper var_pop var_samp variance
weekday weekofyear width_bucket year
""".split())

# Words that may stand before a bracket without being a function.
KEYWORDS = frozenset("""
all and any as by case cast cube distinct else end except exists filter from grouping group having in intersect interval is join lateral like
limit not on or order over partition rollup select sets then try_cast union using values when where with within
""".split()) | {t.split()[0] for t in TYPES} | {"char"}

_TOKEN = re.compile(r"""(?P<skip>\s+|--[^\r\n]*|/\*.*?\*/)|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<tick>`(?:[^`]|``)*`)"""
                    r"""|(?P<word>[^\W\d]\w*)|(?P<sign>::|.)""", re.S)
_NOT_QUERIES = tuple(f"org.apache.spark.sql.catalyst.plans.logical.{name}"
                     for name in ("Command", "ParsedStatement", "CompoundPlanStatement", "ScriptTransformation"))
_RELATION = "org.apache.spark.sql.catalyst.analysis.UnresolvedRelation"
_WITH = "org.apache.spark.sql.catalyst.plans.logical.UnresolvedWith"


def _name(kind: str, token: str) -> str | None:
    if kind == "word":
        return token.lower()
    return token[1:-1].replace("``", "`").lower() if kind == "tick" else None


def to_spark(sql: str, schema: str = SCHEMA) -> str:
    """The statement in Spark's spelling; refuses functions that are not listed."""
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(sql)]
    solid = [k for k, (kind, _) in enumerate(tokens) if kind != "skip"]
    out = [token for _, token in tokens]
    brackets: list[bool] = []  # whether the open bracket is a cast's
    for n, k in enumerate(solid):
        kind, token = tokens[k]
        before = _name(*tokens[solid[n - 1]]) if n else None
        after = [tokens[j] for j in solid[n + 1:n + 4]] + [("end", "")] * 3
        if kind == "word" and token.lower() == "r" and k + 1 < len(tokens) and tokens[k + 1][0] == "text":
            raise ValueError("raw strings are not accepted")
        if token == "(" and kind == "sign":
            brackets.append(before in ("cast", "try_cast"))
        elif token == ")" and kind == "sign" and brackets:
            brackets.pop()
        name = _name(kind, token)
        if name is not None and after[0][1] == "(" and name not in FUNCTIONS and (kind == "tick" or name not in KEYWORDS) and before != "as" \
                and not _names_a_cte(tokens, solid, n):
            raise ValueError(f"function {name} is not accepted")
        if name == schema.lower() and after[0][1] == "." and _name(*after[1]) in TABLE_NAMES:
            out[k] = out[solid[n + 1]] = ""
        if token == "::" or (kind == "word" and name == "as" and brackets and brackets[-1]):
            first, second = _name(*after[0]), _name(*after[1])
            if first and second and f"{first} {second}" in TYPES:
                out[solid[n + 1]], out[solid[n + 2]] = TYPES[f"{first} {second}"], ""
            elif first in TYPES and after[1][1] != "(":
                out[solid[n + 1]] = TYPES[first]
    return "".join(out)


def _names_a_cte(tokens: list, solid: list[int], n: int) -> bool:
    """``name (columns) AS (``: the bracket after the name closes before AS and another bracket."""
    depth = 0
    for at in range(n + 1, len(solid)):
        token = tokens[solid[at]][1]
        depth += (token == "(") - (token == ")")
        if depth == 0:
            rest = [tokens[j][1].lower() for j in solid[at + 1:at + 3]]
            return rest == ["as", "("] and n > 0 and tokens[solid[n - 1]][1].lower() in ("with", ",", "recursive")
    return False


def check_read_only(spark: SparkSession, sql: str, tables: tuple[str, ...] | None = None) -> str:
    """Accept one query over ``tables`` (any relation, if None); decided on Spark's parsed plan before anything runs."""
    from py4j.java_gateway import is_instance_of
    from pyspark.errors import ParseException
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as exc:
        raise ValueError(f"not a single valid query: {exc}") from exc
    gateway, todo, own, used = spark.sparkContext._gateway, [plan], set(), set()
    while todo:
        node = todo.pop()
        if any(is_instance_of(gateway, node, kind) for kind in _NOT_QUERIES):
            raise ValueError("only queries are accepted")
        if is_instance_of(gateway, node, _RELATION):
            used.add(node.multipartIdentifier().mkString(".").lower())
        if is_instance_of(gateway, node, _WITH):
            named = node.cteRelations()
            own |= {named.apply(i)._1().lower() for i in range(named.size())}
        for nested in (node.children(), node.innerChildren()):
            inner = [nested.apply(i) for i in range(nested.size())]
            todo += [n for n in inner if is_instance_of(gateway, n, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")]
    if tables is not None and used - own - set(tables):
        raise ValueError(f"unknown table {', '.join(sorted(used - own - set(tables)))}; there are {', '.join(tables)}")
    return sql


def run(frames: dict[str, DataFrame], sql: str, args: dict | None = None, schema: str = SCHEMA) -> DataFrame:
    """Check, rewrite and analyse a statement over the given tables."""
    spark = next(iter(frames.values())).sparkSession
    text = check_read_only(spark, to_spark(sql, schema), tuple(frames))
    own, mark = spark.newSession(), uuid.uuid4().hex
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    try:
        for name, frame in frames.items():
            frame.createGlobalTempView(f"{name}_{mark}")
            own.table(f"global_temp.{name}_{mark}").createOrReplaceTempView(name)
        return own.sql(text, args=args or None)  # analysed here: the plan holds the tables, not their names
    finally:
        for name in frames:
            spark.catalog.dropGlobalTempView(f"{name}_{mark}")
