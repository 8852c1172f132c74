from pagelake.operators import graph as G
from pyref import bfs

LINKS = [  # (title, parents): self-loop on the root, a two-node cycle, a parent with no page
    ("root", ["root"]), ("a", ["root"]), ("b", ["root", "a"]), ("c", ["a"]), ("d", ["c", "e"]), ("e", ["d"]),
    ("f", ["ghost"]), ("g", ["d"]), ("h", ["g"]), ("i", ["h"]), ("j", ["i"]), ("k", ["j"]),
]


def _cats(spark, links):
    return spark.createDataFrame([(i, t, ps) for i, (t, ps) in enumerate(links)],
                                 "page_id long, title string, cats array<string>")


def test_descendants_match_python_bfs(spark):
    cats = _cats(spark, LINKS)
    for root in ("root", "a", "d", "unknown"):
        got = {}
        for r in G.descendants(cats, root).collect():
            got.setdefault(r.level, set()).add(r.title)
        want = bfs(LINKS, root, rounds=len(LINKS))
        for lv, titles in enumerate(want):
            assert got.get(lv, set()) == set(titles), (root, lv)


def test_index_round_trip_and_projections(spark):
    pages = spark.createDataFrame([(1, "Category:Alpha", ["Beta", ""]), (2, "Help:Page", ["Alpha"]),
                                   (3, "Wikipedia:W", ["Alpha"]), (4, "Article", []), (5, "Category:Beta", ["Alpha"])],
                                  "page_id long, title string, cats array<string>")
    lines = G.category_index_lines(pages)
    assert sorted(r.value for r in lines.collect())[3] == "4|Article|"
    idx, _ = G.parse_category_index(lines)
    cp = sorted((r.page_id, r.title, list(r.cats)) for r in G.category_pages(idx).collect())
    assert cp == [(1, "alpha", ["beta"]), (5, "beta", ["alpha"])]
    content = sorted(r.page_id for r in G.content_pages(idx).collect())
    assert content == [3]
    edges = sorted(tuple(r) for r in G.parent_edges(idx, G.category_pages(idx)).collect())
    assert edges == [(1, 5), (2, 1), (3, 1), (5, 1)]


def test_malformed_index_lines_are_rejected(spark):
    lines = spark.createDataFrame([("nopipe",), ("x|y|z",), ("",), ("7|Category:Q|A||b",)], "value string")
    rows, rejects = G.parse_category_index(lines)
    assert [tuple(r) for r in rows.collect()] == [(7, "category:q", ["a", "b"])]
    assert sorted(r.line for r in rejects.collect()) == ["", "nopipe", "x|y|z"]


def test_deep_chains_are_walked_to_their_end(spark):
    links = [("t0", ["root"])] + [(f"t{i}", [f"t{i - 1}"]) for i in range(1, 12)] + [("x", ["y"]), ("y", ["x"])]
    got = {r.title: r.level for r in G.descendants(_cats(spark, links), "root").collect()}
    assert got == {f"t{i}": i for i in range(12)}
    assert G.descendants(_cats(spark, links), "root", max_depth=5).count() == 6
