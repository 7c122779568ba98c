"""Tree search against a plain walk over the same scores."""

import math
import random

from lexforge.operators import descent, hybrid

NODES = "doc_id long, order_index long, node_id string, parent_id string, type string, level int, heading string, text string, path array<string>"


def forest(seed, docs=4):
    """Trees of headings and leaves in reading order."""
    rng, rows = random.Random(seed), []
    words = ["planner", "robot", "result", "method", "alpha", "beta"]
    for d in range(docs):
        at = [0]

        def put(parent, level, path, d=d, at=at):
            at[0] += rng.randint(1, 3)
            leaf = level > 0 and (level == 6 or rng.random() < 0.5)
            node = f"{d}:{at[0] if level else 'root'}"
            text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 8))) if leaf else ""
            kind = "document" if not level else rng.choice(["section", "abstract"]) if not leaf else "paragraph"
            rows.append((d, at[0] if level else -1, node, parent, kind, level, "" if leaf else rng.choice(words), text, [*path, node]))
            for _ in range(0 if leaf else rng.randint(0, 4) if level else 5):
                put(node, level + 1, [*path, node])

        put(None, 0, [])
    return rows


def walk(rows, scores, chosen, budget):
    """Evidence, ways and opened nodes of one query and document."""
    by_id = {r[2]: r for r in rows}
    children = {}
    for r in sorted(rows, key=lambda r: r[1]):
        children.setdefault(r[3], []).append(r[2])

    def below(node):
        return [x for c in children.get(node, []) for x in [c, *below(c)]]

    found = []
    for node in chosen:
        if not by_id[node][7]:
            leaves = [x for x in below(node) if by_id[x][7]]
            node = min(leaves, key=lambda x: (-round(scores[x], 9), by_id[x][1]), default=node)
        if node not in found:
            found.append(node)
    found = found[:budget]
    opened = {}
    for node in found:
        path = by_id[node][8]
        for k, parent in enumerate(path[:-1]):
            if parent not in opened:
                best = sorted(children[parent], key=lambda c: (-round(max(scores[x] for x in [c, *below(c)]), 9), by_id[c][1]))[:6]
                opened[parent] = (path[k + 1], best)
    return found, opened


def plain_choice(scored, budget):
    """The first half one node of each parent, the second half the best with text after those."""
    rows = sorted((r for r in scored if r["type"] != "document"), key=lambda r: (-round(r["score"], 9), r["text"] == "", r["order_index"]))
    if budget < 4:
        rows = rows[:1] + [r for r in rows[1:] if r["text"]]
    half, out, parents, last = max(2, budget // 2), [], set(), -1
    for n, r in enumerate(rows):
        if len(out) < min(half, budget) and (r["parent_id"] is None or r["parent_id"] not in parents):
            out.append(r["node_id"])
            parents.add(r["parent_id"])
            last = n
    if len(out) == half < budget:
        out += [r["node_id"] for r in rows[last + 1 :] if r["text"]][: budget - half]
    return out


def test_intervals_are_subtrees(spark):
    rows = forest(1)
    got = descent.intervals(spark.createDataFrame(rows, NODES)).select("doc_id", "node_id", "order_index", "leave").collect()
    for r in got:
        inside = {x[2] for x in rows if x[0] == r["doc_id"] and r["order_index"] <= x[1] < r["leave"]}
        assert inside == {x[2] for x in rows if r["node_id"] in x[8]}


def test_tree_search_equals_a_walk(spark):
    rows = forest(2)
    nodes = spark.createDataFrame(rows, NODES).repartition(3)
    asked = spark.createDataFrame([(1, "planner method"), (2, "robot result alpha"), (3, "beta")], "query_id int, query string")
    routed = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (3, 0), (3, 1), (3, 2), (3, 3), (3, 3)], "query_id int, doc_id long")
    rng = random.Random(3)
    signals = spark.createDataFrame([(q, r[2], n + 1, rng.random()) for q in (1, 2, 3) for n, r in enumerate(rng.sample(rows, 10))], "query_id int, node_id string, rank int, vector_score double")
    profiles = hybrid.classify(asked)
    k = 8
    scored = descent.all_scores(nodes, routed, signals, profiles).collect()
    results, ways, opened = descent.tree_search(nodes, routed, signals, profiles, k=k)
    shares = {1: 2, 2: 1, 3: 4}
    want_results, want_ways, want_opened = {}, set(), {}
    for q, docs in {1: [0, 1], 2: [2], 3: [0, 1, 2, 3]}.items():
        budget = max(2, math.ceil(k / shares[q]))
        every = []
        for d in docs:
            mine = {r["node_id"]: r["score"] for r in scored if r["query_id"] == q and r["doc_id"] == d}
            own = [r for r in rows if r[0] == d]
            assert set(mine) == {r[2] for r in own}
            chosen = plain_choice([r for r in scored if r["query_id"] == q and r["doc_id"] == d], budget)
            found, steps = walk(own, mine, chosen, budget)
            every += [(-round(mine[x], 9), d, n + 1, x) for n, x in enumerate(found)]
            want_ways |= {(q, d, n + 1, x) for n, x in enumerate(found)}
            want_opened |= {(q, d, p): v for p, v in steps.items()}
        want_results[q] = [x[3] for x in sorted(every)[:k]]
    got = {}
    for r in sorted(results.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["node_id"])
    assert got == want_results
    assert {(r["query_id"], r["doc_id"], r["place"], r["node_id"]) for r in ways.collect()} == want_ways
    made = {}
    for r in opened.collect():
        made.setdefault((r["query_id"], r["doc_id"], r["node_id"]), [r["chosen"], {}])[1][r["rank"]] = r["child"]
    assert {key: (c, [best[n] for n in sorted(best)]) for key, (c, best) in made.items()} == want_opened


def test_no_routes_and_no_nodes(spark):
    nodes = spark.createDataFrame([], NODES)
    routed = spark.createDataFrame([], "query_id int, doc_id long")
    signals = spark.createDataFrame([], "query_id int, node_id string, rank int, vector_score double")
    profiles = hybrid.classify(spark.createDataFrame([(1, "x")], "query_id int, query string"))
    assert all(x.count() == 0 for x in descent.tree_search(nodes, routed, signals, profiles))
