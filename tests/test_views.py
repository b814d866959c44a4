"""Layouts, filters, cards and the stream of sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import expressions as fx
from graphloom.operators import layout, views
from graphloom.streaming import watch


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_layers_and_cycles():
    assert layout.back_edges([1, 2, 3], {1: [2], 2: [3], 3: [1]}) == {(3, 1)}
    assert layout.layer_of([1, 2, 3, 4], {(1, 2), (2, 3), (3, 1), (1, 4), (3, 4), (4, 4)}) == {1: 0, 2: 1, 3: 2, 4: 3}
    spots = layout.layered([1, 2, 3, 4], [(1, 4), (2, 3)], 100, 100)
    assert spots[1][1] == spots[2][1] < spots[3][1] == spots[4][1] and (spots[1][0] < spots[2][0]) == (spots[4][0] < spots[3][0])


def test_grouped():
    spots, rects = layout.grouped([1, 2, 3, 4, 5], {2: 1, 3: 1, 4: 1, 5: 1}, 1600)
    assert set(rects) == {None, 1} and len(set(spots.values())) == 5
    x, y, w, h = rects[1]
    assert all(x < spots[n][0] < x + w and y < spots[n][1] < y + h for n in (2, 3, 4, 5))


def test_forces_go_on_where_they_stopped():
    edges, weights = np.array([[0, 1], [1, 2], [3, 4]]), np.ones(3)
    one, two = (layout.Forces(5, edges, weights, 800, 600) for _ in range(2))
    one.step(40)
    for _ in range(4):
        two.step()
    assert np.allclose(one.at, two.at) and not one.done
    while not one.step():
        pass
    assert (one.at >= [24, 18]).all() and (one.at <= [776, 582]).all()
    assert layout.Forces(0, edges[:0], weights[:0], 800, 600).done


@pytest.mark.parametrize("kind", ["layered", "grouped", "forces"])
def test_layout_tables(spark, kind):
    nodes = frame(spark, [(1,), (2,), (3,)], "node long")
    edges = frame(spark, [(1, 2, "Contains", 2.0), (2, 3, "Calls", 1.0), (3, 99, "Calls", 1.0), (None, 1, "Calls", 1.0)], "src long, dst long, kind string, weight double")
    got = {r["node"]: (r["x"], r["y"]) for r in layout.layout(nodes, edges, kind).collect()}
    assert set(got) == {1, 2, 3} and len(set(got.values())) == 3
    assert layout.layout(nodes.limit(0), edges.limit(0), kind).count() == 0


def test_filters_and_cards(spark):
    symbols = frame(spark, [(1, "Alpha", "Function", 10, True, False), (2, "beta", "Struct", 11, False, False)], "id long, name string, kind string, module_id long, is_unsafe boolean, has_unsafe_block boolean")
    modules = frame(spark, [(10, "m", "m", None), (11, "n", "m::n", 10), (12, "o", "m::o", 10)], "id long, name string, path string, parent long")
    nodes = frame(spark, [("Symbol", 1), ("Symbol", 2), ("Module", 10)], "node_kind string, node_id long")
    edges = frame(spark, [("Symbol", 1, "Symbol", 2, "Calls"), ("Symbol", 1, "Symbol", 1, "Calls"), ("Module", 10, "Symbol", 1, "Contains")], "src_kind string, src_id long, dst_kind string, dst_id long, kind string")
    shown, kept = views.preset(nodes, edges, "Call Flow", symbols)
    assert [tuple(r) for r in shown.collect()] == [("Symbol", 1)] and kept.count() == 1
    assert [views.preset(nodes, edges, "Everything", symbols)[i].count() for i in (0, 1)] == [3, 3]
    assert [r["id"] for r in views.search_symbols(symbols, "ALP").collect()] == [1]
    assert {r["id"] for r in views.search_tree(modules, symbols, "bet").collect()} == {10, 11}
    assert [r["id"] for r in views.highlighted(symbols, unsafe=True).collect()] == [1] and views.highlighted(symbols).count() == 2
    calls = frame(spark, [(1, 1), (1, 2)], "src long, dst long")
    flags = frame(spark, [("Symbol", 1, "LargeFunction")], "target_kind string, target_id long, kind string")
    card = views.symbol_cards(symbols, modules, frame(spark, [(1, 5)], "symbol_id long, line_count long"), flags, calls).filter("id = 1").first()
    assert (card["module"], card["flags"], card["callers"], card["callees"], card["line_count"]) == ("m", ["LargeFunction"], 1, 2, 5)
    cards = {r["id"]: r for r in views.module_cards(modules, symbols, frame(spark, [(10, 1)], "module_id long, symbol_count long")).collect()}
    assert (cards[10]["children"], cards[11]["parent_path"], cards[11]["symbols_by_kind"]) == (2, "m", {"Struct": 1})
    points = frame(spark, [(1, 10.0, 10.0), (2, 400.0, 10.0)], "node long, x double, y double")
    assert [r["node"] for r in views.in_viewport(points, 0, 0, 60, 60).collect()] == [1]
    own, both = views.overlay(frame(spark, [(1,), (2,)], "node long"), calls, frame(spark, [(1, 1)], "node long, component long"))
    assert {tuple(r) for r in own.collect()} == {(1, True), (2, False)} and {tuple(r) for r in both.collect()} == {(1, 1, True), (1, 2, False)}


def test_expressions(spark):
    df = frame(spark, [("File", None, "a/b.rs", 1234567, "pub", 3.0)], "kind string, name string, path string, n long, signature string, w double")
    r = df.select(
        fx.node_label(F.col("kind"), F.col("name"), F.col("path")).alias("label"),
        fx.node_label(F.lit("Module"), F.col("name"), F.col("path")).alias("missing"),
        fx.format_count(F.col("n")).alias("n"),
        fx.last_segment(F.lit("a::b::c")).alias("last"),
        fx.lighten(fx.node_color(F.lit("Crate")), 50).alias("light"),
        fx.node_alpha(F.lit(False), F.lit(None).cast("boolean"), F.lit(True), F.lit(True)).alias("alpha"),
        fx.edge_width(F.lit(1e9), F.lit(True)).alias("width"),
    ).first()
    assert (r["label"], r["missing"], r["n"], r["last"], r["light"], r["alpha"], r["width"]) == ("b.rs", "?", "1,234,567", "c", [116, 183, 255], 0.15, 6.0)


def test_watch(spark, tmp_path):
    src, out, mark = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    (src / "a.rs").write_text("fn one() {}")
    (src / "b.rs").write_text("fn broken( {")
    watch.watch(spark, str(src), out, mark, once=True).awaitTermination()
    (src / "c.rs").write_text("fn two() {} fn three() {}")
    watch.watch(spark, str(src), out, mark, once=True).awaitTermination()
    now = watch.current(spark, out)
    assert sorted(r["name"] for r in now.select(F.inline("symbols")).collect()) == ["one", "three", "two"]
    assert now.filter("error is not null").count() == 1
