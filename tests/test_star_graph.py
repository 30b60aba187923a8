"""Queries over the whole star graph against brute force in Python."""

import collections

from marlstone.operators import collection_queries as cq, more_queries as mq


def star(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()
    label = {f"region:{r['r_regionkey']}": r["r_name"] for r in read("region")}
    edges = []
    for t, key, up in (("nation", "n", "region"), ("customer", "c", "nation"), ("supplier", "s", "nation")):
        for r in read(t):
            i = f"{t}:{r[{'n': 'n_nationkey', 'c': 'c_custkey', 's': 's_suppkey'}[key]]}"
            label[i] = r[f"{key}_name"]
            edges.append((i, f"{up}:{r[f'{key}_{up}key']}", f"in_{up}"))
    return label, edges


def test_whole_star_graph(spark, sf_dir):
    label, edges = star(spark, sf_dir)
    want = {(a, "outgoing", t, b, label[b]) for a, b, t in edges} | {(b, "incoming", t, a, label[a]) for a, b, t in edges}
    got = cq.star_edges(spark, sf_dir).collect()
    assert len(got) == 2 * len(edges) and {(r["id"], r["direction"], r["type"], r["other"], r["label"]) for r in got} == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["id"], r["direction"]].append((r["position"], r["type"], r["other"]))
    assert all([p for p, *_ in sorted(x)] == list(range(1, len(x) + 1)) and [y[1:] for y in sorted(x)] == sorted(y[1:] for y in x) for x in by.values())

    under = collections.defaultdict(list)
    for a, b, _ in edges:
        under[b].append(a)
    context = {r["id"]: r["context"] for r in cq.entity_contexts(spark, sf_dir).collect()}
    assert set(context) == set(label)
    for i in (x for x in label if x.startswith("nation:")):
        names = sorted({label[a] for a in under[i]})
        more = f" (+{len(under[i]) - 3})" if len(under[i]) > 3 else ""
        assert not names or f"in_nation⁻¹: {', '.join(names[:3])}{more}" in context[i]

    def lines(i, depth):
        return ["  " * depth + "- " + label[i]] + [x for a in sorted(under[i]) for x in lines(a, depth + 1)]

    assert {r["root"]: r["markdown"] for r in mq.region_trees(spark, sf_dir).collect()} == {i: "\n".join(lines(i, 0)) for i in label if i.startswith("region:")}
