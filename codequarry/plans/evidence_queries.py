"""Queries over types, ledger cards and evidence, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents
from ..functions import text as T
from ..operators import cards, evidence, fulltext, graph, resolve, typed
from ..operators.checkpoints import shared_folder
from . import answers
from . import fixtures as fx
from .queries import _BM25, WORDS, query

# Types. Classes are suppliers, nations and regions; methods are parts; calls are suppliers times ten names.
_LONG = "regexp_replace(regexp_replace(regexp_replace({0}, '^S', 'Sup'), '^N', 'Nat'), '^R', 'Reg')"
PARAMS = ["int", "long", "String", "Object", "Sup1", "Nat1", "Reg1", "T"]
ARGS = ["int", "String", "Sup1", "Sup2", "null", "Integer", "Nat1"]
RETURNS = ["Sup1", "Nat2", "Reg1", "Sup3"]


def _sql(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_TYPES = f"""WITH hx AS (SELECT {_LONG.format("class_name")} AS class_name, {_LONG.format("parent_name")} AS parent_name FROM fx_hierarchy),
 cl AS (SELECT class_name, parent_name AS ancestor, 1 AS depth FROM hx UNION ALL SELECT a.class_name, b.parent_name, 2 FROM hx a JOIN hx b ON b.class_name = a.parent_name),
 me AS (SELECT p_partkey AS symbol_id, CASE p_partkey % 3 WHEN 0 THEN concat('Sup', CAST(p_partkey % 10 AS STRING)) WHEN 1 THEN concat('Nat', CAST(p_partkey % 25 AS STRING)) ELSE concat('Reg', CAST(p_partkey % 5 AS STRING)) END AS owner,
  concat('m', CAST(p_size % 10 AS STRING)) AS name, ({_sql(PARAMS)}[p_partkey % 8 + 1 : p_partkey % 8 + 1] || {_sql(PARAMS)}[(p_partkey // 8) % 8 + 1 : (p_partkey // 8) % 8 + 1])[: CAST(p_size % 3 AS INT)] AS param_types,
  CAST(CASE WHEN p_partkey % 7 = 0 THEN greatest(p_size % 3 - 1, 0) ELSE p_size % 3 END AS INT) AS n_least, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size % 3 AS INT) END AS n_most,
  CAST(p_size * 10 AS BIGINT) AS start_line, {_sql(RETURNS)}[p_partkey % 4 + 1] AS return_type FROM part),
 ca AS (SELECT s_suppkey * 10 + k AS call_id, concat('Sup', CAST(s_suppkey % 10 AS STRING)) AS receiver_type, concat('m', CAST(k AS STRING)) AS name, CAST((s_suppkey + k) % 3 AS INT) AS arg_count,
  ({_sql(ARGS)}[(s_suppkey * 3 + k) % 7 + 1 : (s_suppkey * 3 + k) % 7 + 1] || {_sql(ARGS)}[(s_suppkey + 2 * k) % 7 + 1 : (s_suppkey + 2 * k) % 7 + 1])[: CAST((s_suppkey + k) % 3 AS INT)] AS arg_types FROM supplier CROSS JOIN (SELECT unnest(range(10)) AS k))"""


def _array(xs):
    return F.array(*map(F.lit, xs))


def _closure(spark, d):
    h = fx.hierarchy(spark, d)
    for short, long in (("S", "Sup"), ("N", "Nat"), ("R", "Reg")):
        h = h.withColumns({c: F.regexp_replace(c, f"^{short}(?=\\d)", long) for c in ("class_name", "parent_name")})
    return graph.ancestors(h)


def _methods(spark, d):
    k, size = F.col("p_partkey"), (F.col("p_size") % 3).cast("int")
    named = lambda word, n: F.concat(F.lit(word), (k % n).cast("string"))
    at = lambda n: F.element_at(_array(PARAMS), (n % 8).cast("int") + 1)
    return fx.table(spark, d, "part").select(
        k.alias("symbol_id"), F.when(k % 3 == 0, named("Sup", 10)).when(k % 3 == 1, named("Nat", 25)).otherwise(named("Reg", 5)).alias("owner"),
        F.concat(F.lit("m"), (F.col("p_size") % 10).cast("string")).alias("name"), F.slice(F.array(at(k), at(F.floor(k / 8))), F.lit(1), size).alias("param_types"),
        F.when(k % 7 == 0, F.greatest(size - 1, F.lit(0))).otherwise(size).alias("n_least"), F.when(k % 7 != 0, size).alias("n_most"),
        (F.col("p_size") * 10).cast("long").alias("start_line"), F.element_at(_array(RETURNS), (k % 4).cast("int") + 1).alias("return_type"),
    )


def _calls(spark, d):
    s, k = F.col("s_suppkey"), F.col("k")
    at = lambda n: F.element_at(_array(ARGS), (n % 7).cast("int") + 1)
    n = ((s + k) % 3).cast("int")
    rows = fx.table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    return rows.select((s * 10 + k).alias("call_id"), F.concat(F.lit("Sup"), (s % 10).cast("string")).alias("receiver_type"), F.concat(F.lit("m"), k.cast("string")).alias("name"), n.alias("arg_count"), F.slice(F.array(at(s * 3 + k), at(s + 2 * k)), F.lit(1), n).alias("arg_types"))


def _canonical(c):
    return f"CASE {c} WHEN 'Integer' THEN 'int' WHEN 'String' THEN 'string' WHEN 'Object' THEN 'object' ELSE {c} END"


_FIT = f"""CASE WHEN p = 'T' THEN 1 WHEN a = 'null' THEN CASE WHEN p IN ('int', 'long') THEN -5 ELSE 1 END
 WHEN {_canonical("a")} = {_canonical("p")} THEN CASE WHEN a = 'Integer' THEN 5 ELSE 6 END WHEN p = 'Object' THEN 1 WHEN a IN ('int', 'Integer') AND p = 'long' THEN 4
 WHEN a IN ('int', 'Integer') OR p IN ('int', 'long') THEN CASE WHEN a IN ('int', 'Integer') THEN -5 WHEN a = 'String' OR a LIKE 'Sup%' OR a LIKE 'Nat%' THEN -5 ELSE 0 END
 WHEN a = 'String' THEN -5 WHEN p = 'String' THEN -5 WHEN p IN (SELECT ancestor FROM cl WHERE class_name = a) THEN 4 ELSE -5 END"""
_LEVELS = ", lv AS (SELECT class_name AS rt, ancestor AS owner, depth AS level FROM cl UNION ALL SELECT DISTINCT receiver_type, receiver_type, 0 FROM ca), fo AS (SELECT * FROM (SELECT c.call_id, c.arg_count, c.arg_types, l.level, m.*, row_number() OVER (PARTITION BY c.call_id, array_to_string(m.param_types, ',') ORDER BY l.level, m.start_line, m.symbol_id) AS n FROM ca c JOIN lv l ON l.rt = c.receiver_type JOIN me m ON m.owner = l.owner AND m.name = c.name) WHERE n = 1)"


@query(_TYPES + _LEVELS + " SELECT call_id, symbol_id, level, array_to_string(param_types, ',') AS param_types FROM fo")
def members_by_level(spark, d):
    found = typed.members_by_level(_calls(spark, d), _methods(spark, d), _closure(spark, d))
    return found.select("call_id", "symbol_id", "level", F.array_join("param_types", ",").alias("param_types"))


@query(_TYPES + _LEVELS + f""", po AS (SELECT * FROM (SELECT *, arg_count BETWEEN n_least AND coalesce(n_most, 1000000) AS fits, count(*) OVER w AS n_pool, count(CASE WHEN arg_count BETWEEN n_least AND coalesce(n_most, 1000000) THEN 1 END) OVER w AS n_fit FROM fo WINDOW w AS (PARTITION BY call_id)) WHERE n_fit = 0 OR fits),
 pr AS (SELECT call_id, symbol_id, unnest(arg_types) AS a, unnest(list_transform(range(1, CAST(arg_count + 1 AS BIGINT)), lambda i: param_types[i])) AS p FROM po WHERE arg_count > 0),
 sc AS (SELECT call_id, symbol_id, sum(CASE WHEN p IS NULL THEN 0 ELSE {_FIT} END) AS score FROM pr GROUP BY 1, 2), to_ AS (SELECT po.*, score, max(score) OVER (PARTITION BY call_id) AS top FROM po LEFT JOIN sc USING (call_id, symbol_id)),
 nb AS (SELECT *, count(CASE WHEN top >= 0 AND score = top THEN 1 END) OVER (PARTITION BY call_id) AS n_best FROM to_),
 la AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY level, start_line, symbol_id) AS k FROM nb WHERE n_best = 0 OR (top >= 0 AND score = top))
 SELECT call_id, symbol_id, level, CASE WHEN n_pool = 1 THEN 'single' WHEN n_fit = 1 THEN 'arity' WHEN n_best = 1 THEN 'types' ELSE 'group' END AS how FROM la WHERE k = 1""")
def typed_overload_pick(spark, d):
    return typed.overloads(_calls(spark, d), _methods(spark, d), _closure(spark, d))


@query(_TYPES + """, ex AS (SELECT c.call_id, m.start_line, m.symbol_id FROM ca c JOIN me m ON m.name = c.name AND m.symbol_id % 4 = 1 AND len(m.param_types) > 0
  WHERE (m.param_types[1] = c.receiver_type OR m.param_types[1] IN (SELECT ancestor FROM cl WHERE class_name = c.receiver_type) OR m.param_types[1] IN ('Object', 'T')) AND c.arg_count BETWEEN greatest(m.n_least - 1, 0) AND coalesce(m.n_most - 1, 1000000))
 SELECT call_id, arg_min(symbol_id, start_line * 10000000 + symbol_id) AS symbol_id, CASE WHEN count(*) = 1 THEN 'extension_method' ELSE 'overload_group' END AS scope FROM ex GROUP BY call_id""")
def extension_methods(spark, d):
    methods = _methods(spark, d).withColumn("is_extension", (F.col("symbol_id") % 4 == 1) & (F.size("param_types") > 0)).withColumns({"n_least": F.greatest(F.col("n_least") - 1, F.lit(0)), "n_most": F.col("n_most") - 1})
    return typed.extension_methods(_calls(spark, d), methods, _closure(spark, d))


def _step(k):
    return f", s{k} AS (SELECT call_id, CASE WHEN len(st) < {k} THEN t ELSE o.next END AS t, st FROM s{k - 1} LEFT JOIN off o ON o.class_name = t AND o.name = st[{k}])"


@query(_TYPES + """, de AS (SELECT owner, name, CASE WHEN min(return_type) = max(return_type) THEN min(return_type) END AS next FROM me GROUP BY 1, 2),
 le AS (SELECT class_name, ancestor AS owner, depth FROM cl UNION SELECT class_name, class_name, 0 FROM cl UNION SELECT ancestor, ancestor, 0 FROM cl),
 off AS (SELECT class_name, name, next FROM (SELECT l.class_name, d.name, d.next, row_number() OVER (PARTITION BY l.class_name, d.name ORDER BY l.depth) AS k FROM le l JOIN de d USING (owner) WHERE true) WHERE k = 1),
 s0 AS (SELECT call_id, receiver_type AS t, [name, concat('m', CAST(call_id % 4 AS STRING)), concat('m', CAST(call_id % 9 AS STRING))][: CAST(call_id % 3 + 1 AS INT)] AS st FROM ca)"""
    + "".join(map(_step, (1, 2, 3, 4))) + " SELECT call_id AS chain_id, t AS type FROM s4")
def chain_types(spark, d):
    named = lambda n: F.concat(F.lit("m"), (F.col("call_id") % n).cast("string"))
    chains = _calls(spark, d).select(F.col("call_id").alias("chain_id"), F.col("receiver_type").alias("root"), F.slice(F.array(F.col("name"), named(4), named(9)), F.lit(1), (F.col("call_id") % 3 + 1).cast("int")).alias("steps"))
    return typed.chain_types(chains, _methods(spark, d), _closure(spark, d))


@query("""WITH s AS (SELECT concat('f', CAST(p_size AS STRING)) AS name, CASE p_partkey % 4 WHEN 0 THEN 'Path' WHEN 1 THEN 'int' WHEN 2 THEN concat('C', CAST(p_size % 2 AS STRING)) ELSE NULL END AS t FROM part)
 SELECT name, CASE WHEN min(t) = max(t) THEN min(t) ELSE '' END AS type FROM s WHERE t IS NOT NULL AND t <> 'int' GROUP BY name""")
def return_type_table(spark, d):
    k = F.col("p_partkey") % 4
    returned = F.when(k == 0, "-> Path:").when(k == 1, "-> int:").when(k == 2, F.concat(F.lit("-> C"), (F.col("p_size") % 2).cast("string"), F.lit("[str]:"))).otherwise(":")
    rows = fx.table(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("name"), F.lit("function").alias("kind"), F.concat(F.lit("def f(a: int) "), returned).alias("signature"))
    return typed.return_types(rows)


@query("""SELECT p_partkey AS symbol_id, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 1 END AS least, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN NULL ELSE 1 END AS most FROM part""")
def arity_ranges(spark, d):
    size = F.col("p_size") % 5
    sig = F.when(size == 0, "class X").when(size == 1, "void f()").when(size == 2, "void f(Map<String, List<int>> m, int n = 3)").when(size == 3, "void f(String a, int... rest)").otherwise("static int f(this Foo foo, bool b)")
    found = typed.arity_range(typed.parameters(sig))
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), found["least"].alias("least"), found["most"].alias("most"))


@query("""WITH t AS (SELECT p_partkey AS symbol_id, p_size % 6 AS k, replace(p_name, ' ', '_') AS n FROM part) SELECT symbol_id, CASE k WHEN 0 THEN n WHEN 1 THEN 'Map' WHEN 2 THEN concat(n, '[]') WHEN 3 THEN 'StringBuilder' WHEN 4 THEN n ELSE '' END AS type_key,
 CASE k WHEN 0 THEN n WHEN 1 THEN 'Map' WHEN 2 THEN '' WHEN 3 THEN 'StringBuilder' WHEN 4 THEN n ELSE '' END AS receiver_type FROM t""")
def clean_types(spark, d):
    n, k = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size") % 6
    text = F.when(k == 0, n).when(k == 1, "java.util.Map<String, List<Foo>>").when(k == 2, F.concat(n, F.lit("[]"))).when(k == 3, "global::System.Text.StringBuilder").when(k == 4, F.concat(F.lit("@NonNull "), n, F.lit("?"))).otherwise("(int, int)")
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), typed.type_key(text).alias("type_key"), typed.clean_type(text).alias("receiver_type"))


_STUBS = [("requests", "get", "get"), ("builtins", "list", "append"), ("m7", "Session", "send"), ("m9", "TestCase", "assertEqual"), ("m11", "run", "go"), ("unused", "x", "go")]
_STUB_SQL = "WITH sb AS (SELECT *, row_number() OVER (ORDER BY position) AS stub_id FROM (" + " UNION ALL ".join(f"SELECT {k} AS position, '{p}' AS package, '{e}' AS export_path, '{m}' AS member_name" for k, (p, e, m) in enumerate(_STUBS)) + ") WHERE package = 'builtins' OR package IN (SELECT module FROM fx_imports))"


def _stubs(spark, d):
    given = spark.createDataFrame([(k, *s) for k, s in enumerate(_STUBS)], "position int, package string, export_path string, member_name string")
    return typed.relevant_stubs(given, fx.imports(spark, d))


@query(_STUB_SQL + " SELECT stub_id, package, member_name FROM sb")
def relevant_stubs(spark, d):
    return _stubs(spark, d).select(F.col("stub_id").cast("long").alias("stub_id"), "package", "member_name")


@query(_STUB_SQL + """, c AS (SELECT DISTINCT path, ['send', 'append', 'assertEqual', 'go'][i] AS name, [NULL, 'm7', 'self', NULL][(CAST(substr(path, 6, 1) AS INT) + i) % 4 + 1] AS receiver, CASE WHEN i = 3 THEN ['pkg.TestCase', 'Own'] ELSE [] END AS types, i FROM fx_imports CROSS JOIN (SELECT unnest(range(1, 5)) AS i)),
 r AS (SELECT c.path, c.name, s.stub_id, CASE WHEN coalesce(c.receiver NOT IN ('self', 'this', 'cls') AND (c.receiver = s.package OR c.receiver = s.export_path), false) THEN 1 WHEN list_contains(list_transform(c.types, lambda t: split_part(t, '.', -1)), s.export_path) THEN 2
  WHEN c.receiver IS NULL AND EXISTS (SELECT 1 FROM fx_imports f WHERE f.path = c.path AND f.module = s.package) THEN 3 END AS rule FROM c JOIN sb s ON s.member_name = c.name),
 g AS (SELECT path, name, rule, count(*) AS n, min(stub_id) AS stub_id FROM r WHERE rule IS NOT NULL GROUP BY 1, 2, 3)
 SELECT concat(path, ':', name) AS call_id, arg_min(stub_id, rule) AS stub_id FROM g WHERE rule = 2 OR n = 1 GROUP BY 1""")
def stub_calls(spark, d):
    i = F.col("i")
    receiver = F.element_at(F.array(F.lit(None).cast("string"), F.lit("m7"), F.lit("self"), F.lit(None).cast("string")), (F.substring("path", 6, 1).cast("int") + i) % 4 + 1)
    rows = fx.imports(spark, d).select("path").distinct().withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("name", F.element_at(_array(["send", "append", "assertEqual", "go"]), i))
    rows = rows.select(F.concat("path", F.lit(":"), "name").alias("call_id"), "path", "name", receiver.alias("receiver"), F.when(i == 3, _array(["pkg.TestCase", "Own"])).otherwise(F.array().cast("array<string>")).alias("types"))
    found = typed.stub_calls(rows, _stubs(spark, d), fx.imports(spark, d))
    return found.select("call_id", F.col("stub_id").cast("long").alias("stub_id"))


# Ledger cards: one per order.
_CARDS = """WITH cd AS (SELECT o_orderkey AS card_id, concat('r', CAST(o_custkey % 3 AS STRING)) AS repo_id, ['retired', 'conflicted', 'confirmed', 'asserted', 'asserted'][o_orderkey % 5 + 1] AS status, o_orderkey % 4 AS confirmations, CAST(o_orderkey % 100 AS DOUBLE) AS expires_at,
 list_distinct([concat('t', CAST(o_custkey % 7 AS STRING)), concat('t', CAST(o_orderkey % 11 AS STRING)), concat('t', CAST(o_orderkey % 6 AS STRING))]) AS sig_tokens, [concat('t', CAST(o_custkey % 9 AS STRING))] AS answer_stems, [concat('t', CAST(o_orderkey % 8 AS STRING))] AS decoy_stems FROM orders)"""


def _cards(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = lambda col, n: F.concat(F.lit("t"), (col % n).cast("string"))
    return fx.table(spark, d, "orders").select(
        k.alias("card_id"), F.concat(F.lit("r"), (c % 3).cast("string")).alias("repo_id"), F.element_at(_array(["retired", "conflicted", "confirmed", "asserted", "asserted"]), (k % 5).cast("int") + 1).alias("status"), (k % 4).alias("confirmations"),
        (k % 100).cast("double").alias("expires_at"), F.array_distinct(F.array(t(c, 7), t(k, 11), t(k, 6))).alias("sig_tokens"), F.array(t(c, 9)).alias("answer_stems"), F.array(t(k, 8)).alias("decoy_stems"),
    )


@query(_CARDS + " SELECT card_id, repo_id, status FROM cd WHERE status IN ('asserted', 'confirmed') AND expires_at > 40 AND list_has_any(sig_tokens, ['t1', 't2', 't5']) ORDER BY card_id LIMIT 50")
def card_candidates(spark, d):
    return cards.candidates(_cards(spark, d), ["t1", "t2", "t5"], 40.0).select("card_id", "repo_id", "status")


_SCORED = _CARDS + """, sc AS (SELECT *, len(list_intersect(sig_tokens, ['t1', 't2', 't5'])) * 1.0e0 / len(list_distinct(list_concat(sig_tokens, ['t1', 't2', 't5']))) AS score, list_filter(['t1', 't2', 't5'], lambda x: NOT list_contains(sig_tokens, x)) AS added, list_filter(sig_tokens, lambda x: NOT list_contains(['t1', 't2', 't5'], x)) AS dropped FROM cd),
 al AS (SELECT * FROM sc WHERE score >= 0.3 AND len(sig_tokens) - len(dropped) >= 2 AND NOT list_has_any(added, list_filter(decoy_stems, lambda x: NOT list_contains(answer_stems, x))) AND NOT (len(added) > 0 AND len(dropped) > 0 AND NOT list_has_any(added, answer_stems)))"""


@query(_SCORED + " SELECT card_id, round(score, 6) AS score FROM al")
def cards_alike(spark, d):
    return cards.scored(_cards(spark, d), ["t1", "t2", "t5"], 0.3, 2).select("card_id", F.round("score", 6).alias("score"))


@query(_SCORED + " SELECT card_id, status, confirmations FROM al ORDER BY CASE WHEN status = 'confirmed' THEN 0 ELSE 1 END, round(score, 6) DESC, confirmations DESC, card_id LIMIT 1")
def ledger_best_card(spark, d):
    return cards.best_card(cards.scored(_cards(spark, d), ["t1", "t2", "t5"], 0.3, 2)).select("card_id", "status", "confirmations")


@query(_CARDS + " SELECT repo_id, count(*) AS n_deleted FROM cd WHERE expires_at <= 40 OR status = 'retired' GROUP BY repo_id")
def ledger_prune(spark, d):
    return cards.prune(_cards(spark, d), 40.0)[1]


@query(_CARDS + " SELECT card_id, CASE WHEN card_id % 9 = 0 THEN 'retired' ELSE status END AS status FROM cd")
def ledger_set_status(spark, d):
    c = _cards(spark, d)
    return cards.set_status(c, c.filter("card_id % 9 = 0").select("card_id", F.lit("retired").alias("status"))).select("card_id", "status")


# A card's items are the lines of the order: a symbol's body counts as its name.
_ITEMS = _CARDS + """, it AS (SELECT l_orderkey AS card_id, ['answer', 'step', 'decoy'][l_linenumber % 3 + 1] AS role, CAST(l_linenumber AS INT) AS ord, s.path, CASE WHEN l_suppkey % 10 = 0 THEN 'gone' ELSE s.qualified_name END AS qualified_name, CASE WHEN l_partkey % 4 = 0 THEN 'old' ELSE sha256(s.name) END AS body_sha256, s.symbol_id AS sid FROM lineitem JOIN fx_symbols s ON s.symbol_id = l_partkey),
 sy AS (SELECT path, qualified_name, min(symbol_id) AS symbol_id, sha256(min(name)) AS sha FROM fx_symbols GROUP BY 1, 2), ve AS (SELECT it.*, sy.symbol_id, CASE WHEN sy.sha IS NULL THEN 'missing' WHEN sy.sha <> body_sha256 THEN 'changed' ELSE 'valid' END AS state FROM it LEFT JOIN sy USING (path, qualified_name))"""


def _bodies(spark, d):
    return fx.symbols(spark, d).groupBy("path", "qualified_name").agg(F.min("symbol_id").alias("symbol_id"), F.sha2(F.min("name"), 256).alias("body_sha256"))


def _items(spark, d):
    s = fx.symbols(spark, d).select(F.col("symbol_id").alias("l_partkey"), "path", "qualified_name", "name")
    return fx.table(spark, d, "lineitem").join(s, "l_partkey").select(
        F.col("l_orderkey").alias("card_id"), F.element_at(_array(["answer", "step", "decoy"]), (F.col("l_linenumber") % 3).cast("int") + 1).alias("role"), F.col("l_linenumber").cast("int").alias("ord"), "path",
        F.when(F.col("l_suppkey") % 10 == 0, "gone").otherwise(F.col("qualified_name")).alias("qualified_name"), F.when(F.col("l_partkey") % 4 == 0, "old").otherwise(F.sha2("name", 256)).alias("body_sha256"),
    )


@query(_ITEMS + " SELECT card_id, role, state, count(*) AS n FROM ve GROUP BY 1, 2, 3")
def evidence_states(spark, d):
    return cards.verified(_items(spark, d), _bodies(spark, d)).groupBy("card_id", "role", "state").agg(F.count("*").alias("n"))


@query(_ITEMS + """, br AS (SELECT card_id, min(CASE WHEN role = 'step' AND state <> 'valid' THEN ord END) AS recheck_from FROM ve GROUP BY 1)
 SELECT card_id, status, recheck_from, count(CASE WHEN role = 'answer' AND state = 'valid' THEN 1 END) AS n_answers, count(CASE WHEN role = 'step' AND state = 'valid' AND ord < coalesce(recheck_from, 1000) THEN 1 END) AS n_steps,
 count(CASE WHEN role = 'decoy' AND state = 'valid' AND status = 'confirmed' AND confirmations >= 2 THEN 1 END) AS n_decoys, count(CASE WHEN role = 'answer' AND state = 'valid' THEN 1 END) = 0 AS retire FROM ve JOIN br USING (card_id) JOIN cd USING (card_id) GROUP BY 1, 2, 3""")
def prior_evidence(spark, d):
    scored = _cards(spark, d).withColumn("score", F.col("confirmations") / 4)
    return cards.prior_evidence(cards.verified(_items(spark, d), _bodies(spark, d)), scored, 0.5)


@query("""WITH s AS (SELECT *, concat(CAST(symbol_id AS STRING), CASE symbol_id % 4 WHEN 0 THEN '' ELSE '@' END, CASE symbol_id % 5 WHEN 0 THEN 'x' ELSE CAST(start_line + symbol_id % 50 AS STRING) END) AS input FROM fx_symbols),
 a AS (SELECT input, symbol_id, start_line, end_line, path FROM s UNION ALL SELECT concat('no', CAST(symbol_id AS STRING), '@5'), NULL, NULL, NULL, NULL FROM fx_symbols WHERE symbol_id < 50)
 SELECT input, CASE WHEN symbol_id IS NULL THEN 'unknown_symbol' WHEN symbol_id % 4 = 0 OR symbol_id % 5 = 0 THEN 'invalid_format' WHEN path LIKE '%1.py' THEN 'stale_file' WHEN start_line + symbol_id % 50 > end_line THEN 'line_outside_symbol' END AS reason FROM a""")
def gate_answers(spark, d):
    s, k = fx.symbols(spark, d), F.col("symbol_id")
    given = s.select(F.concat(k.cast("string"), F.when(k % 4 == 0, "").otherwise("@"), F.when(k % 5 == 0, "x").otherwise((F.col("start_line") + k % 50).cast("string"))).alias("input"))
    given = given.unionByName(s.filter("symbol_id < 50").select(F.concat(F.lit("no"), k.cast("string"), F.lit("@5")).alias("input")))
    return cards.gate_answers(given, s, s.select("path").distinct().filter(~F.col("path").endswith("1.py")))


# Steps go from a text's first line on to what the line says next.
_STEP_FIXTURE = r"""WITH f AS (SELECT path, line, list_filter(string_split_regex(line, '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w, row_number() OVER (ORDER BY path) AS id FROM fx_lines WHERE line_no = 1)"""


@query(_STEP_FIXTURE + """, s AS (SELECT id, path, w[1] AS name, 1 AS start_line, 3 AS end_line FROM f WHERE len(w) > 0), st AS (SELECT concat(CAST(id AS STRING), '>', CAST(CASE id % 5 WHEN 0 THEN id WHEN 1 THEN id + 1 ELSE id + 2 END AS STRING), '@', CASE id % 7 WHEN 0 THEN '9' ELSE '1' END) AS input, id, CASE id % 5 WHEN 0 THEN id WHEN 1 THEN id + 1 ELSE id + 2 END AS b, CASE id % 7 WHEN 0 THEN 9 ELSE 1 END AS line FROM s)
 SELECT st.input, CASE WHEN st.id = st.b THEN 'self_loop_step' WHEN t.name IS NULL THEN 'unknown_symbol' WHEN st.id % 11 = 0 THEN 'stale_file' WHEN st.line > 3 THEN 'line_outside_symbol' WHEN NOT list_contains(f.w, t.name) THEN 'evidence_mismatch' END AS reason,
 st.id <> st.b AND t.name IS NOT NULL AND st.id % 11 <> 0 AND st.line <= 3 AND list_contains(f.w, t.name) AND st.id % 2 = 1 AS edge_missing FROM st JOIN f ON f.id = st.id LEFT JOIN s t ON t.id = st.b""")
def gate_steps(spark, d):
    from pyspark.sql import Window

    first = fx.lines(spark, d).filter("line_no = 1").withColumn("w", F.regexp_extract_all("line", F.lit(f"({T.TERM})"), F.lit(1))).withColumn("symbol_id", F.row_number().over(Window.orderBy("path")))
    s = first.filter(F.size("w") > 0).select("symbol_id", "path", F.get("w", F.lit(0)).alias("name"), F.lit(1).alias("start_line"), F.lit(3).alias("end_line"))
    k = F.col("symbol_id")
    to = F.when(k % 5 == 0, k).when(k % 5 == 1, k + 1).otherwise(k + 2)
    steps = s.select(F.concat(k.cast("string"), F.lit(">"), to.cast("string"), F.lit("@"), F.when(k % 7 == 0, "9").otherwise("1")).alias("input"))
    edges = s.filter(k % 2 == 0).select(k.alias("source_symbol_id"), to.alias("target_symbol_id"))
    return cards.gate_steps(steps, s, s.filter(k % 11 != 0).select("path").distinct(), fx.lines(spark, d), edges)


@query("""SELECT concat(CAST(symbol_id AS STRING), CASE symbol_id % 3 WHEN 0 THEN '' ELSE '!' END, CASE symbol_id % 4 WHEN 0 THEN 'nope' ELSE 'unrelated' END) AS input,
 CASE WHEN symbol_id % 3 = 0 THEN 'invalid_format' WHEN symbol_id % 4 = 0 THEN 'invalid_reason_code' WHEN path LIKE '%1.py' THEN 'stale_file' END AS reason FROM fx_symbols""")
def gate_decoys(spark, d):
    s, k = fx.symbols(spark, d), F.col("symbol_id")
    given = s.select(F.concat(k.cast("string"), F.when(k % 3 == 0, "").otherwise("!"), F.when(k % 4 == 0, "nope").otherwise("unrelated")).alias("input"))
    return cards.gate_decoys(given, s, s.select("path").distinct().filter(~F.col("path").endswith("1.py")))


@query("""WITH r AS (SELECT symbol_id, path, qualified_name, name, symbol_id AS pos FROM fx_symbols), o AS (SELECT path, qualified_name, CASE WHEN min(symbol_id) % 3 = 0 THEN 'answer' ELSE 'decoy' END AS role FROM fx_symbols WHERE symbol_id % 20 = 0 GROUP BY 1, 2)
 SELECT r.symbol_id, r.pos, CASE WHEN o.role = 'answer' THEN 0 WHEN o.role = 'decoy' AND NOT starts_with(name, 'red') THEN 2 ELSE 1 END AS tier FROM r LEFT JOIN o USING (path, qualified_name)""")
def ledger_overlay(spark, d):
    s = fx.symbols(spark, d).withColumn("pos", F.col("symbol_id"))
    roles = s.filter("symbol_id % 20 = 0").groupBy("path", "qualified_name").agg(F.when(F.min("symbol_id") % 3 == 0, "answer").otherwise("decoy").alias("role"))
    return cards.overlay_order(s, roles, F.col("name").startswith("red")).select("symbol_id", "pos", "tier")


# What the other modules offer.
@query("""WITH e AS (SELECT source_symbol_id % 50 AS source_symbol_id, target_symbol_id % 20 AS target_symbol_id, edge_kind, n_calls, source_symbol_id AS line, target_symbol_id AS t FROM fx_edges),
 k AS (SELECT *, row_number() OVER (PARTITION BY source_symbol_id, target_symbol_id, edge_kind ORDER BY line, t) AS n FROM e) SELECT source_symbol_id, target_symbol_id, edge_kind, line FROM k WHERE n = 1""")
def edges_deduped(spark, d):
    e = fx.edges(spark, d)
    rows = e.select((F.col("source_symbol_id") % 50).alias("source_symbol_id"), (F.col("target_symbol_id") % 20).alias("target_symbol_id"), "edge_kind", F.col("source_symbol_id").alias("line"), F.col("target_symbol_id").alias("t")).withColumns({"target_stub_id": F.lit(None).cast("string"), "target_name": F.lit("f")})
    return resolve.dedupe(rows, ["line", "t"]).select("source_symbol_id", "target_symbol_id", "edge_kind", "line")


@query("""WITH s AS (SELECT path, concat(path, ':', CAST(i AS STRING)) AS symbol_id, i * 2 - 1 AS start_line, i * 2 + 2 AS end_line FROM fx_files CROSS JOIN (SELECT unnest(range(1, 4)) AS i)),
 h AS (SELECT path, line_no, """ + " + ".join(f"CAST(regexp_matches(line, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])') AS INT)" for w in WORDS) + """ AS score FROM fx_lines),
 j AS (SELECT s.symbol_id, coalesce(h.line_no, s.start_line) AS line_no, coalesce(h.score, 0) AS score FROM s LEFT JOIN (SELECT * FROM h WHERE score > 0) h ON h.path = s.path AND h.line_no BETWEEN s.start_line AND s.end_line),
 r AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY score DESC, line_no) AS n FROM j) SELECT symbol_id, line_no, score, n FROM r WHERE n <= 2""")
def symbol_best_lines(spark, d):
    i = F.col("i")
    s = fx.files(spark, d).select("path", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).select("path", F.concat("path", F.lit(":"), i.cast("string")).alias("symbol_id"), (i * 2 - 1).cast("long").alias("start_line"), (i * 2 + 2).cast("long").alias("end_line"))
    return fulltext.symbol_lines(fx.lines(spark, d), s, WORDS).withColumn("n", F.col("n").cast("long"))


@query(r"""WITH m AS (SELECT path, line_no, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS k FROM fx_lines WHERE regexp_matches(line, '^[A-T]')), b AS (SELECT path, min(line_no) AS a, max(line_no) AS z FROM m GROUP BY path, k)
 SELECT s.path, s.start_line, b.a AS doc_start FROM (SELECT path, unnest(range(2, 6)) AS start_line FROM fx_files) s JOIN b ON b.path = s.path AND b.z = s.start_line - 1""")
def doc_inheritance(spark, d):
    s = fx.files(spark, d).select("path", F.explode(F.sequence(F.lit(2).cast("long"), F.lit(5).cast("long"))).alias("start_line"))
    return evidence.doc_of_symbols(s, evidence.doc_blocks(fx.lines(spark, d), "^[A-T]")).select("path", "start_line", "doc_start")


@query("SELECT sha256(concat(CAST(count(*) AS STRING), '|', CAST(sum(CAST(CAST(concat('0x', substr(sha256(concat(class_name, '|', parent_name)), 1, 15)) AS BIGINT) AS HUGEINT)) AS STRING), '|', '500')) AS digest FROM fx_hierarchy")
def edge_context_hash(spark, d):
    return evidence.edge_context_digest(fx.hierarchy(spark, d), 500)


@query(r"""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS a FROM benchmark), p AS (SELECT x.item_id, len(list_intersect(x.a, y.a)) * 1.0e0 AS n, len(x.a) AS nx, len(y.a) AS ny FROM t x JOIN t y ON y.item_id = x.item_id + 1)
 SELECT item_id, round(CASE WHEN nx > 0 THEN n / nx ELSE 1 END, 4) AS verified_share, round(CASE WHEN ny > 0 THEN n / ny ELSE 1 END, 4) AS coverage FROM p""")
def guardrail_coverage(spark, d):
    t = fx.table(spark, d, "benchmark").select("item_id", F.array_distinct(T.terms(F.col("text"))).alias("a"))
    share, coverage = evidence.grounded(F.col("a"), F.col("b"))
    return t.join(t.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id").select("item_id", F.round(share, 4).alias("verified_share"), F.round(coverage, 4).alias("coverage"))


@query("SELECT path FROM fx_files WHERE mtime_ns % 3000000000 <> 0 AND mtime_ns < 50000000000 - 2000000000")
def reusable_files(spark, d):
    from ..sources.snapshot import reusable

    before = fx.files(spark, d).select("path", "size", "mtime_ns")
    return reusable(before, before.withColumn("size", F.col("size") + (F.col("mtime_ns") % 3_000_000_000 == 0).cast("long")), F.lit(50_000_000_000))


@query(_BM25 + " SELECT path, round(score, 4) AS score, n_terms FROM s ORDER BY round(score, 6), path LIMIT 20")
def fts_index_topk(spark, d):
    """The same answer from the inverted index as a table: only the terms' partitions are read."""
    import uuid

    path = f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}"
    docs = fx.files(spark, d).select("path", "text")
    n, mean = fulltext.write_index(docs, "path", {"text": 1.0}, path, buckets=16)
    found = fulltext.bm25(fulltext.read_index(spark, path, WORDS, buckets=16), n, mean, WORDS)
    return found.orderBy(F.round("score", 6), "id").limit(20).select(F.col("id").alias("path"), F.round("score", 4).alias("score"), "n_terms")


@query("""SELECT relation, other_id, round(confidence, 4) AS confidence, row_number() OVER (ORDER BY CASE relation WHEN 'callee' THEN 0 ELSE 1 END, confidence DESC, other_id, status) AS pos FROM (SELECT 'callee' AS relation, target_symbol_id AS other_id, confidence, status FROM fx_edges WHERE source_symbol_id = 7
 UNION ALL SELECT 'caller', source_symbol_id, confidence, status FROM fx_edges WHERE target_symbol_id = 7)""")
def relationship_order(spark, d):
    from pyspark.sql import Window

    rows = graph.relationships(fx.edges(spark, d), 7)
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*graph.relationship_order())).cast("long")).select("relation", "other_id", F.round("confidence", 4).alias("confidence"), "pos")


# Answers made of others.
@query("SELECT path, CASE WHEN starts_with(path, 'tests/') OR path LIKE '%/tests/%' THEN 2 WHEN starts_with(path, 'evals/') THEN 1 ELSE 0 END AS path_group FROM fx_files")
def caller_groups(spark, d):
    return fx.files(spark, d).select("path", answers.path_group(F.col("path")).alias("path_group"))


@query("SELECT (count(CASE WHEN language IN ('en', 'fr') THEN 1 END) * 2 >= count(*)) AS enabled FROM fx_files WHERE parse_status = 'parsed'")
def word_form_gate(spark, d):
    return answers.word_forms(fx.files(spark, d), ("en", "fr"))


@query("SELECT path AS id FROM fx_terms WHERE term IN ('the', 'and') GROUP BY path HAVING count(DISTINCT term) = 2")
def body_id_set(spark, d):
    index = fulltext.inverted_index(fx.files(spark, d).select("path", "text"), "path", {"text": 1.0})
    return answers.body_matches(index, ["the", "and"])


@query("""SELECT path, CASE WHEN regexp_matches(s, '^doc_[0-9]*5') THEN list_min(list_filter(['7', '1', 'oc', '25'], lambda t: contains(s, t))) END AS term FROM (SELECT path, regexp_replace(lower(split_part(path, '/', -1)), '^(.+)\\.[^.]*$', '\\1') AS s FROM fx_files)""".replace("\\\\", "\\"))
def stage_path_match(spark, d):
    return fx.files(spark, d).select("path", answers.stage_match(F.col("path"), ["7", "1", "oc", "25"], "^doc_[0-9]*5").alias("term"))


@query(r"""WITH w AS (SELECT p_partkey, list_filter(flatten(list_transform(string_split(p_name, ' '), lambda y: list_concat([lower(y)], [lower(y)]))), lambda x: length(x) >= 3) AS a FROM part)
 SELECT p_partkey AS symbol_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS terms FROM w""")
def bench_query_terms(spark, d):
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.array_join(answers.word_parts(F.col("p_name")), ",").alias("terms"))


@query("SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS at FROM fx_audit")
def iso_times(spark, d):
    return fx.audit(spark, d).select("id", answers.iso_utc(F.col("ts")).alias("at"))


@query("""WITH a AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'admin' WHEN id % 7 = 0 THEN 'no spaces' WHEN id % 11 = 0 THEN NULL ELSE agent_id END AS asked FROM fx_audit)
 SELECT id, CASE WHEN coalesce(asked, '') IN ('admin', 'no spaces') THEN NULL ELSE coalesce(asked, 'anonymous') END AS agent, CASE asked WHEN 'admin' THEN 'reserved_agent_id' WHEN 'no spaces' THEN 'invalid_agent_id' END AS error FROM a""")
def agent_identities(spark, d):
    k = F.col("id")
    asked = F.when(k % 5 == 0, "admin").when(k % 7 == 0, "no spaces").when(k % 11 == 0, F.lit(None)).otherwise(F.col("agent_id"))
    agent, error = answers.agent_identity(asked, None)
    return fx.audit(spark, d).select("id", agent.alias("agent"), error.alias("error"))


@query("SELECT row_number() OVER (ORDER BY path, start_line, symbol_id) AS pos, concat(CAST(symbol_id AS STRING), chr(9), path, chr(9), name, chr(9), CAST(start_line AS STRING)) AS line FROM fx_symbols")
def compact_text(spark, d):
    return answers.compact_text(fx.symbols(spark, d), ["symbol_id", "path", "name", "start_line"], ["path", "start_line", "symbol_id"])


@query("SELECT symbol_id, name, kind, path, start_line FROM fx_symbols")
def minimal_view(spark, d):
    return answers.project(answers.wire_symbols(fx.symbols(spark, d)), "minimal")


@query("""WITH o AS (SELECT target_symbol_id AS symbol_id, max(confidence) AS c, 'callee' AS relation FROM fx_edges WHERE source_symbol_id = 7 AND target_symbol_id <> 7 AND status = 'resolved' AND confidence >= 0.6 GROUP BY 1
 UNION ALL SELECT source_symbol_id, max(confidence), 'caller' FROM fx_edges WHERE target_symbol_id = 7 AND source_symbol_id <> 7 AND status = 'resolved' AND confidence >= 0.5 GROUP BY 1)
 SELECT relation, s.symbol_id, row_number() OVER (PARTITION BY relation ORDER BY CASE WHEN relation = 'callee' THEN -c ELSE 0 END, CASE WHEN relation = 'caller' THEN -CAST(s.symbol_id % 13 AS DOUBLE) ELSE 0 END, s.path, s.start_line, s.symbol_id) AS pos FROM o JOIN fx_symbols s USING (symbol_id)""")
def packet_neighbours(spark, d):
    s = fx.symbols(spark, d).withColumn("signature", F.lit(""))
    ranks = s.select("symbol_id", (F.col("symbol_id") % 13).cast("double").alias("score"))
    near = answers.neighbours(s, fx.edges(spark, d).withColumn("source_line", F.lit(1)), ranks, 7)
    return near.select("relation", "symbol_id", F.col("pos").cast("long").alias("pos"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN concat('{\"a\":[\"x\",\"[REDACTED: potential secret]\"],\"n\":', CAST(id AS STRING), '}') WHEN id % 3 = 1 THEN '[REDACTED: potential secret]' ELSE '{\"b\":{\"c\":\"plain\"}}' END AS details FROM fx_audit")
def redact_nested(spark, d):
    k = F.col("id")
    given = F.when(k % 3 == 0, F.concat(F.lit('{"a": ["x", "password = hunter22"], "n": '), k.cast("string"), F.lit("}"))).when(k % 3 == 1, "token: abcdefgh").otherwise('{"b": {"c": "plain"}}')
    return fx.audit(spark, d).select("id", documents.redact_json(given).alias("details"))


@query("SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 0 ELSE CAST(ceil(strlen(text) / 4.0) AS BIGINT) END AS n, 'estimate' AS method FROM documents")
def counted_tokens(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", documents.counted_tokens(F.col("text")).alias("c")).select("doc_id", "c.n", "c.method")


# Scripts: a file imports by a path relative to its own folder.
_SCRIPTS = """WITH f AS (SELECT DISTINCT concat('web/', CASE o_custkey % 3 WHEN 0 THEN 'a/' WHEN 1 THEN 'a/b/' ELSE '' END, 'f', CAST(o_custkey % 20 AS STRING), CASE o_custkey % 4 WHEN 0 THEN '/index.js' WHEN 1 THEN '.ts' ELSE '.js' END) AS path FROM orders),
 i AS (SELECT DISTINCT concat('web/a/b/c', CAST(o_orderkey % 10 AS STRING), '.js') AS path, concat(['./', '../', '../../', '../b/'][o_orderkey % 4 + 1], 'f', CAST(o_custkey % 20 AS STRING)) AS module FROM orders),
 j AS (SELECT path, module, concat(CASE WHEN starts_with(module, '../../') THEN 'web/' WHEN starts_with(module, '../b/') OR starts_with(module, './') THEN 'web/a/b/' ELSE 'web/a/' END, split_part(module, '/', -1)) AS base FROM i),
 c AS (SELECT path, module, base, unnest(['', '.js', '.jsx', '.ts', '.tsx', '.mjs', '.cjs', '/index.js']) AS ending, unnest(range(8)) AS pos FROM j)"""


@query(_SCRIPTS + " SELECT c.path, c.module, arg_min(f.path, c.pos) AS target FROM c JOIN f ON f.path = concat(c.base, c.ending) GROUP BY 1, 2")
def script_imports(spark, d):
    o = fx.table(spark, d, "orders")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    name = F.concat(F.lit("f"), (c % 20).cast("string"))
    files = o.select(F.concat(F.lit("web/"), F.when(c % 3 == 0, "a/").when(c % 3 == 1, "a/b/").otherwise(""), name, F.when(c % 4 == 0, "/index.js").when(c % 4 == 1, ".ts").otherwise(".js")).alias("path")).distinct()
    imports = o.select(F.concat(F.lit("web/a/b/c"), (k % 10).cast("string"), F.lit(".js")).alias("path"), F.concat(F.element_at(_array(["./", "../", "../../", "../b/"]), (k % 4).cast("int") + 1), name).alias("module")).distinct()
    return evidence.script_links(imports, files)


# All rules of the cascade: calls are suppliers times ten names, candidates the parts of that name.
_CASCADE = """WITH c AS (SELECT s_suppkey * 10 + k AS call_id, p.p_name, k, s_suppkey, ['self', 'this.x', 'Brand_11', 'other', NULL, NULL, NULL][k % 7 + 1] AS receiver, CASE k % 3 WHEN 0 THEN 'Brand_11.f' WHEN 1 THEN 'Brand_22.Inner.f' ELSE 'f' END AS caller_qualified,
  CASE WHEN k % 4 = 1 THEN 'Brand_12' END AS receiver_type, concat(CASE s_suppkey % 2 WHEN 0 THEN 'src/' ELSE 'lib/' END, 'brand_', CAST(10 * (s_suppkey % 5 + 1) + k % 5 + 1 AS STRING), '.py') AS call_path, CASE WHEN s_suppkey % 3 = 0 THEN 'n1' END AS call_namespace, CASE WHEN s_suppkey % 7 = 0 THEN ['src.brand_13'] ELSE [] END AS imported, CAST((s_suppkey + k) % 7 AS INT) AS arg_count
  FROM supplier CROSS JOIN (SELECT unnest(range(10)) AS k) JOIN part p ON p.p_partkey = s_suppkey * 7 + k),
 j AS (SELECT c.*, s.symbol_id, s.qualified_name, s.path, s.start_line, s.symbol_id % 7 AS n_params, split_part(s.qualified_name, '.', 1) AS owner, CASE WHEN s.symbol_id % 9 = 0 THEN 'n1' END AS namespace FROM c JOIN fx_symbols s ON s.name = replace(c.p_name, ' ', '_')),
 r AS (SELECT *, CASE WHEN receiver IN ('self', 'this') AND owner = regexp_replace(caller_qualified, '\\.[^.]*$', '') AND contains(caller_qualified, '.') THEN 0 WHEN receiver = 'this.x' AND receiver_type = owner THEN 1 WHEN receiver_type = owner THEN 2 WHEN receiver = owner THEN 3
  WHEN receiver IS NULL AND contains(caller_qualified, '.') AND owner = regexp_replace(caller_qualified, '\\.[^.]*$', '') THEN 4 WHEN call_path = path THEN 5 WHEN list_contains(imported, replace(replace(path, '.py', ''), '/', '.')) THEN 6 WHEN namespace = call_namespace THEN 7 WHEN starts_with(call_path, 'src/') THEN 8 ELSE 9 END AS rule FROM j),
 g AS (SELECT call_id, rule, count(*) AS n, count(DISTINCT concat(qualified_name, '|', path)) AS n_names, count(CASE WHEN n_params = arg_count THEN 1 END) AS n_fit, arg_min(symbol_id, (CASE WHEN n_params = arg_count THEN 0 ELSE 1 END) * 1000000000000 + start_line * 10000000 + symbol_id) AS best FROM r GROUP BY 1, 2),
 f AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY rule) AS k FROM g)
 SELECT call_id, CASE WHEN n = 1 OR n_names = 1 THEN best END AS target_symbol_id, CASE WHEN n = 1 OR n_names = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
 CASE WHEN n = 1 THEN ['same_class', 'attr_type', 'exact_receiver_type', 'receiver_match', 'implicit_this', 'same_file', 'import_match', 'same_namespace', 'same_package', 'global'][rule + 1] WHEN n_names = 1 AND n_fit = 1 THEN 'overload_arity' WHEN n_names = 1 THEN 'overload_group' ELSE 'ambiguous' END AS scope, n AS n_candidates FROM f WHERE k = 1"""


@query(_CASCADE.replace("\\\\", "\\"))
def rule_cascade(spark, d):
    s, k = F.col("s_suppkey"), F.col("k")
    rows = fx.table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    calls = rows.join(fx.table(spark, d, "part").select("p_partkey", "p_name"), F.col("p_partkey") == s * 7 + k).select(
        (s * 10 + k).alias("call_id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"),
        F.element_at(F.array(*[F.lit(x).cast("string") for x in ("self", "this.x", "Brand_11", "other", None, None, None)]), (k % 7).cast("int") + 1).alias("receiver"),
        F.when(k % 3 == 0, "Brand_11.f").when(k % 3 == 1, "Brand_22.Inner.f").otherwise("f").alias("caller_qualified"), F.when(k % 4 == 1, "Brand_12").alias("receiver_type"),
        F.concat(F.when(s % 2 == 0, "src/").otherwise("lib/"), F.lit("brand_"), (10 * (s % 5 + 1) + k % 5 + 1).cast("string"), F.lit(".py")).alias("call_path"),
        F.when(s % 3 == 0, "n1").alias("call_namespace"), F.when(s % 7 == 0, _array(["src.brand_13"])).otherwise(F.array().cast("array<string>")).alias("imported"), ((s + k) % 7).cast("int").alias("arg_count"),
    )
    symbols = fx.symbols(spark, d).select("symbol_id", "name", "qualified_name", "path", "start_line", (F.col("symbol_id") % 7).alias("n_params"), F.when(F.col("symbol_id") % 9 == 0, "n1").alias("namespace"), T.module_candidates(F.col("path")).alias("candidate_modules"))
    return resolve.by_context(calls, symbols, "name", [c for c in calls.columns if c != "call_id"], resolve.scopes()).select("call_id", "target_symbol_id", "status", "scope", "n_candidates")
