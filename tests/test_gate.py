"""The gate's decisions against a walk through the items."""

import random

from parley.operators import gate as G

QUERIES = "query_id long, query string, mode string, timed_out boolean, relationship boolean"
ITEMS = "query_id long, rank int, kind string, score double, task double, off_topic boolean, shares_term boolean"


def walk(query, items):
    _, text, mode, late, relation = query
    items = sorted(items, key=lambda i: i[1])
    if late:
        return "skip", "timeout", 0.0, 0.0, 0, 0
    if text and any(w in text.replace(" ", "") for w in G.SENSITIVE) and any(w in text.replace(" ", "") for w in G.LOOKUPS):
        return "no_hit", "sensitive_query_block", 0.0, 0.0, 0, 0
    if not items:
        return "skip", "no_result", 0.0, 0.0, 0, 0
    n_off = sum(bool(i[5]) for i in items)
    use = lambda action, reason, chosen, off=n_off: (action, reason, round(chosen[0][3], 4), chosen[0][4], len(chosen), off)
    asked = mode == "memory_request"
    facts = [i for i in items if i[2] == "fact_memory" and (i[3] >= 0.3 or (asked and i[6]))]
    if facts:
        return use("inject", "memory_request_match" if asked else "fact_memory_match", facts, 0)
    if asked:
        found = [i for i in items if i[2] in G.MEMORY and not i[5] and (i[4] >= 0.5 or (i[2] == "fact_memory" and i[3] >= 0.1 and i[6]))]
        if found and round(found[0][3], 4) > 0:
            return use("inject", "memory_request_match", found)
    if items[0][2] == "hot_context" and items[0][3] >= 0.2:
        return use("inject", "hot_context", items[:1])
    found = [i for i in items if i[2] in G.RELATIONSHIP and not i[5] and (i[4] >= 0.35 or i[3] >= 0.25)]
    if (mode == "relationship_context" or relation) and found:
        return use("weak_inject", "weak_relationship_context", found)
    found = [i for i in items if i[2] in G.ORDINARY and not i[5] and i[4] >= 0.62 and i[3] >= 0.48]
    if found:
        return use("inject", "task_relevant_memory", found)
    found = [i for i in items if i[2] in G.STYLE and not i[5] and (i[4] >= 0.35 or i[3] >= 0.35)]
    if found:
        return use("weak_inject", "style_context", found)
    rest = round(items[0][3], 4), max(i[4] for i in items), 0, n_off
    if n_off == len(items):
        return "skip", "off_topic_memory", *rest
    if asked and any(i[2] == "fact_memory" and i[3] >= 0.1 for i in items):
        return "skip", "memory_low_confidence", *rest
    return "skip", "low_score", *rest


def test_decisions(spark):
    pick = random.Random(1)
    kinds = sorted({*G.ORDINARY, *G.MEMORY, *G.RELATIONSHIP, *G.STYLE, "other"})
    queries, items = [], []
    for q in range(900):
        queries.append((q, pick.choice((None, "hello", "他的 手机号是多少", "手机号")), pick.choice((None, "", "memory_request", "relationship_context")), pick.random() < 0.05 or None, pick.choice((True, False, None))))
        few = pick.choice((kinds, ["fact_memory"], ["other", "topic_segment"], ["hot_context", "self_style_example"]))
        off = pick.random()
        items += [(q, r, pick.choice(few), round(pick.random() ** 2, 3), round(pick.random() ** 2, 3), pick.random() < off, pick.random() < 0.3) for r in range(pick.randrange(5))]
    found = {r.query_id: tuple(r[1:]) for r in G.decisions(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(items, ITEMS).repartition(4)).collect()}
    want = {q[0]: walk(q, [i for i in items if i[0] == q[0]]) for q in queries}
    assert found == want
    assert len({w[1] for w in want.values()}) == 12
