"""Queries over their whole tables, against brute force that reads no SQL."""

import collections

from codequarry.plans import fixtures as fx
from codequarry.plans.queries import QUERIES

D = "/root/testdata/sf0.001"


def test_every_call_is_decided(spark):
    by_name = collections.defaultdict(list)
    for s in fx.symbols(spark, D).collect():
        by_name[s.name].append(s)

    def decided(c):
        here = [s for s in by_name[c.call_name] if s.path == c.path]
        found, scope = (here, "same_file") if here else (by_name[c.call_name], "global")
        fits = [s for s in found if s.symbol_id % 7 == c.arg_count]
        one_name = len({(s.qualified_name, s.path) for s in found}) == 1
        if len(found) > 1:
            scope = "ambiguous" if not one_name else "overload_arity" if len(fits) == 1 else "overload_group"
        best = min(found, key=lambda s: (s not in fits, s.start_line, s.symbol_id)).symbol_id if one_name else None
        return c.call_id, c.path, c.call_name, best, "resolved" if one_name else "ambiguous", scope, len(found)

    calls = fx.calls(spark, D).collect()
    got = [tuple(r) for r in QUERIES["rule_priority_resolve"](spark, D).collect()]
    assert len(got) == len(calls) and sorted(got, key=str) == sorted(map(decided, calls), key=str)


def test_every_edge_counts(spark):
    edges = fx.edges(spark, D).collect()
    resolved, sure = sum(e.status == "resolved" for e in edges), sum(e.confidence >= 0.6 for e in edges)
    assert [tuple(r) for r in QUERIES["completeness"](spark, D).collect()] == [(round(resolved / len(edges), 4), len(edges))]
    r = QUERIES["edge_gold_pr"](spark, D).first()
    assert (r["n"], r["precision"], r["recall"]) == (len(edges), 1.0, round(sure / len(edges), 4))
