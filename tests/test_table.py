"""Operators of the table against small expected results."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tabloom as tl
from tabloom import schema as S
from tabloom.functions import dates, numeric
from tabloom.operators import ordered
from tabloom.plans import factories as step
from tabloom.plans.pipeline import ErrorLog, MutablePipeline, Transform, compose, concat_pipelines, from_mutable, from_result, from_table
from tabloom.sources.delimited import CSVReader, CSVWriter, to_string
from tabloom.sources.jsonfiles import JSONReader, JSONWriter
from tabloom.table import JSONOptions, from_frame, set_strict

pytestmark = pytest.mark.usefixtures("spark")


def people():
    return tl.new(["name", "city", "age"], [["Ann", "Berlin", "30"], ["Bob", "Paris", "25"], ["Cid", "Berlin", ""]])


def sales():
    return tl.new(["region", "product", "revenue", "label"], [["EU", "A", "10", "x"], ["US", "A", "20.5", "y"], ["EU", "B", "bad", "z"], ["EU", "A", "5", "w"], ["US", "B", "1", ""]])


def test_new_makes_names_unique_and_rows_rectangular():
    t = tl.new(["a", "a", "a_2"], [["1"], ["1", "2", "3", "4"]])
    assert t.headers == ["a", "a_2", "a_2_2"]
    assert t.records() == [["1", "", ""], ["1", "2", "3"]]


def test_projections():
    t = people()
    assert t.select("city", "name").headers == ["city", "name"]
    bad = t.with_source("f.csv").select("name", "nope")
    assert bad.headers == ["name"] and str(bad.errs()[0]) == '[f.csv] Select: unknown column "nope"'
    assert t.rename("name", "city").headers == ["city", "city_2", "age"]
    assert t.map("name", str.upper).col("name") == ["ANN", "BOB", "CID"]
    assert t.add_col("x", lambda r: r["name"] + r["age"]).col("x") == ["Ann30", "Bob25", "Cid"]
    assert t.transform(lambda r: {"age": "1", "no": "2"}).col("age") == ["1", "1", "1"]
    assert t.add_row_index("i").records()[1] == ["1", "Bob", "Paris", "25"]
    assert t.coalesce("c", "nope", "age", "name").col("c") == ["30", "25", "Cid"]


@pytest.mark.parametrize("x,text", [(450.0, "450"), (0.1, "0.1"), (1e7, "10000000"), (1.5e21, "1500000000000000000000"), (1e-7, "0.0000001"), (-2.5e-5, "-0.000025"), (123456789.125, "123456789.125"), (0.0, "0")])
def test_floats_print_shortest(x, text):
    assert tl.new(["a"], [[repr(x)]]).add_col_float("f", numeric.add("a")).col("f") == [text]


def test_fixed_precision_uses_the_binary_value():
    assert tl.new(["a"], [["1.005"], ["2.675"], ["0.125"], ["x"]]).format_col("a", 2).col("a") == ["1.00", "2.67", "0.12", "x"]


def test_bad_numbers_are_zero_or_skipped():
    t = tl.new(["a", "b"], [["1d", "2"], ["7", "0"], ["-7", "2"]])
    assert t.add_col_float("s", numeric.add("a", "b")).col("s") == ["2", "7", "-5"]
    assert t.add_col_float("s", numeric.div("a", "b")).col("s") == ["0", "0", "-3.5"]
    assert t.add_col_float("s", numeric.mod("a", "b")).col("s") == ["0", "0", "-1"]


def test_joins():
    emp = tl.new(["name", "dept_id"], [["Ann", "10"], ["Bob", "20"], ["Cid", "30"]])
    dept = tl.new(["dept_id", "name"], [["10", "Ops"], ["20", "Dev"], ["40", "HR"]])
    assert emp.join(dept, "dept_id", "dept_id").records() == [["Ann", "10", "Ops"], ["Bob", "20", "Dev"]]
    assert emp.left_join(dept, "dept_id", "dept_id").records()[2] == ["Cid", "30", ""]
    assert emp.right_join(dept, "dept_id", "dept_id").records()[2] == ["", "40", "HR"]
    assert emp.outer_join(dept, "dept_id", "dept_id").records() == [["Ann", "10", "Ops"], ["Bob", "20", "Dev"], ["Cid", "30", ""], ["", "40", "HR"]]
    assert emp.outer_join(dept, "dept_id", "dept_id").headers == ["name", "dept_id", "name_2"]
    assert emp.anti_join(dept, "dept_id", "dept_id").col("name") == ["Cid"]
    assert emp.lookup("dept_id", "d", tl.concat(dept, tl.new(["dept_id", "name"], [["10", "New"]])), "dept_id", "name").col("d") == ["New", "Dev", ""]
    assert len(tl.cartesian_product(emp, dept).records()) == 9


def test_group_by_agg_in_first_seen_order():
    got = sales().group_by_agg(["region"], [("s", tl.Sum("revenue")), ("m", tl.Mean("revenue")), ("n", tl.Count("label")), ("j", tl.StringJoin("label", "+")), ("f", tl.First("product")), ("l", tl.Last("label"))])
    assert got.records() == [["EU", "15", "7.5", "3", "x+z+w", "A", "w"], ["US", "21.5", "10.75", "1", "y", "A", ""]]
    assert sales().where(F.lit(False)).group_by_agg([], [("n", tl.Count("label"))]).records() == []
    assert sales().group_by_agg(["region"], [("s", tl.Sum("no")), ("m", tl.Mean("no"))]).records() == [["EU", "0", ""], ["US", "0", ""]]


def test_value_counts_and_pivot_and_melt():
    assert sales().value_counts("region").records() == [["EU", "3"], ["US", "2"]]
    assert sales().pivot("region", "product", "revenue").records() == [["EU", "5", "bad"], ["US", "20.5", "1"]]
    assert people().melt(["name"], "k", "v").records()[:3] == [["Ann", "city", "Berlin"], ["Ann", "age", "30"], ["Bob", "city", "Paris"]]
    assert tl.new(["a", "b"], [["1", "2"], ["3", "4"]]).transpose().records() == [["a", "1", "3"], ["b", "2", "4"]]


def test_row_order_operators():
    t = tl.new(["m", "r"], [["1", "100"], ["2", "150"], ["3", "x"], ["4", "200.5"], ["5", "150"]])
    assert t.lag("r", "p", 1).col("p") == ["", "100", "150", "x", "200.5"]
    assert t.lead("r", "p", 2).col("p") == ["x", "200.5", "150", "", ""]
    assert t.lag("r", "p", -3).col("p") == t.col("r")
    assert t.cum_sum("r", "c").col("c") == ["100", "250", "250", "450.5", "600.5"]
    assert t.rank("r", "k").col("k") == ["1", "2", "", "3", "2"]
    assert t.rank("r", "k", False).col("k") == ["3", "2", "", "1", "2"]
    assert t.rolling_agg("s", 2, tl.Sum("r")).col("s") == ["100", "250", "150", "200.5", "350.5"]
    gaps = tl.new(["a"], [[""], ["x"], [""], [""], ["y"], [""]])
    assert gaps.fill_forward("a").col("a") == ["", "x", "x", "x", "y", "y"]
    assert gaps.fill_backward("a").col("a") == ["x", "x", "y", "y", "y", ""]


def test_sorts_are_stable_and_by_bytes():
    t = tl.new(["a", "b"], [["9", "1"], ["10", "2"], ["é", "3"], ["B", "4"], ["", "5"], ["9", "6"]])
    assert t.sort("a").col("b") == ["5", "2", "1", "6", "4", "3"]
    assert t.sort("a", False).col("b") == ["3", "4", "1", "6", "2", "5"]
    assert t.sort("a").add_row_index("i").col("i") == list("012345")
    assert t.sort("a").lag("b", "p", 1).col("p") == ["", "5", "2", "1", "6", "4"]
    assert [c.col("b") for c in t.chunk(4)] == [["1", "2", "3", "4"], ["5", "6"]]
    assert t.tail(2).col("b") == ["5", "6"] and t.head(0).records() == []


def test_sets():
    a, b = tl.new(["x", "y"], [["1", "a"], ["2", "b"], ["1", "c"]]), tl.new(["y", "x", "z"], [["q", "1", "!"], ["b", "2", "!"]])
    assert a.append(b).records()[3:] == [["1", "q"], ["2", "b"]]
    assert a.distinct("x").records() == [["1", "a"], ["2", "b"]]
    assert tl.union(a, b, "x", "y").records() == [["1", "a"], ["2", "b"], ["1", "c"], ["1", "q"]]
    assert a.intersect(b, "x").records() == a.records()


def test_explode_keeps_rows_without_parts():
    t = tl.new(["a", "b"], [["x, y ,", "1"], [" , ", "2"], ["", "3"]])
    assert t.explode("a", ",").records() == [["x", "1"], ["y", "1"], [" , ", "2"], ["", "3"]]


def test_json_cells():
    t = tl.new(["id", "d"], [["1", '{"u":{"n":"A","a":[1.10,2]},"s":1e3,"t":null}'], ["2", "[1,2]"], ["3", "oops"], ["4", ""]])
    assert t.head(1).expand_json("d").records() == [["1", '{"a":[1.10,2],"n":"A"}', "1e3", ""]]
    flat = t.expand_json("d", JSONOptions(flatten=True))
    assert flat.headers == ["id", "d.u.n", "d.u.a.0", "d.u.a.1", "d.s", "d.t", "d.0", "d.1"]
    assert flat.records()[0][2] == "1.10" and flat.records()[2] == ["3"] + [""] * 7
    assert t.map_json("d", ".u.a[0]").col("d") == ["1.10", "[1,2]", "oops", ""]
    assert t.map_json("d", mapping={"x": ".u.n", "y": ".no"}).col("d")[0] == '{"x":"A"}'
    assert t.try_map_json("d", ".u.n").is_err()
    assert t.head(1).try_map_json("d", ".u.n").unwrap().col("d") == ["A"]
    assert t.expand_json("d", JSONOptions(mapping={"x": "u"})).has_errs()


def test_dates():
    t = tl.new(["d"], [["2024-01-31"], ["15.03.2024"], ["02 Jan 2006"], ["2024-05-01T23:30:00+02:00"], ["abc"], ["0001-01-01"]])
    assert t.add_col("x", dates.add_months("d", 1)).col("x") == ["2024-03-02", "2024-04-15", "2006-02-02", "2024-06-01", "", ""]
    assert t.add_col("x", dates.weekday("d")).col("x")[:2] == ["Wednesday", "Friday"]
    assert t.add_col("x", dates.format_("d", "Jan 2, 2006 at 15:04")).col("x")[3] == "May 1, 2024 at 23:30"
    assert t.add_col_float("x", dates.diff_days("d", "d")).col("x") == ["0"] * 6


def test_infer_is_read_in_order():
    def kind(*cells):
        return S.infer(tl.new(["v"], [[c] for c in cells])).col("v").name

    assert kind("1", "2.5") == "FLOAT" and kind("1", "hello") == "STRING" and kind("yes", "no") == "BOOL"
    assert kind("5", "yes") == "BOOL" and kind("yes", "5") == "STRING" and kind("15.01.2024") == "DATE" and kind("", "") == "STRING"


def test_schema_apply():
    t = tl.new(["a", "b", "c"], [[" 007", "Yes", "1,000.50"], ["", "no", "2"]])
    s = S.Schema({"a": S.ColType.INT, "b": S.ColType.BOOL}).cast("c", S.ColType.FLOAT)
    assert s.apply(t).unwrap().records() == [["7", "true", "1000.5"], ["", "false", "2"]]
    assert 'column "a" row 1' in str(s.apply_strict(t).error)
    assert 'column "b" row 0: cannot parse "Yes"' in str(S.Schema({"b": S.ColType.INT}).apply(t).error)


def test_describe():
    t = tl.new(["v", "w"], [[x, "a"] for x in "24445579"])
    assert S.describe(t).records() == [["v", "8", "2", "9", "5", "2", "4.5"], ["w", "0", "", "", "", "", ""]]
    assert S.min_max_norm(tl.new(["v"], [["1"], ["x"], ["3"]]), "v").col("v") == ["0", "x", "1"]


def test_fallible_steps_and_reject_log():
    t = tl.new(["name", "price"], [["a", "1.5"], ["b", "bad"], ["c", "3.0"]]).with_source("p.csv")
    double = lambda v: str(float(v) * 2)
    assert t.try_map("price", double).is_err()
    log = ErrorLog()
    out = from_table(t).with_error_log(log).try_map("price", double).try_map("name", lambda v: 1 / 0 if v == "c" else v).unwrap()
    assert out.records() == [["a", "3.0"]]
    assert log.to_table().records() == [["p.csv", "TryMap(price)", "1", "could not convert string to float: 'bad'", "b", "bad"], ["p.csv", "TryMap(name)", "1", "division by zero", "c", "6.0"]]
    assert log.len() == 2 and log.has_errors() and log.entries()[0].row == 1
    assert from_table(t).with_error_log(log).try_map("no", double).is_err()


def test_pipelines():
    t = people()
    p = from_table(t).with_tracing().step("keep", step.drop_empty("age")).apply(Transform("up", lambda q: q.then(step.map("name", str.upper))))
    assert [(r.name, r.input_rows, r.output_rows) for r in p.trace()] == [("keep", 3, 2), ("up", 2, 2)]
    assert p.unwrap().col("name") == ["ANN", "BOB"]
    bad = p.assert_columns("nope")
    assert bad.is_err() and bad.then(step.head(1)).is_err() and bad.recover_with(t).is_ok()
    assert bad.on_error(lambda e: t).is_ok() and "!" in str(bad.map_err(lambda e: ValueError("!")).held.error)
    assert from_table(t).assert_no_empty("age").held.error.args[0] == 'row 2: column "age" is empty'
    a, b = from_table(t).fan_out(step.head(1), step.tail(1))
    assert concat_pipelines(a, b).unwrap().col("name") == ["Ann", "Cid"]
    assert sorted(from_table(t).group_by("city")) == ["Berlin", "Paris"]
    assert compose(step.head(2), step.select("age"))(t).records() == [["30"], ["25"]]
    assert from_result(CSVReader().read_file("/no/such/file.csv")).is_err()


def test_mutable_tables_change_in_place():
    m = people().thaw()
    frozen = m.freeze()
    assert m.where(m.eq("city", "Berlin")) is m and m.col("name") == ["Ann", "Cid"]
    assert frozen.len() == 3
    m.set(1, "age", "9").append_row(["Dan"])
    assert m.records() == [["Ann", "Berlin", "30"], ["Cid", "Berlin", "9"], ["Dan", "", ""]]
    m.set(9, "age", "1").distinct("nope").assert_columns("q")
    assert len(m.errs()) == 3
    m.reset_errs()
    assert not m.has_errs() and m.group_by_agg(["nope"], []).len() == 0
    q = from_mutable(people().thaw()).then(step.head(2))
    assert isinstance(q, MutablePipeline) and q.frozen().unwrap().len() == 2


def test_strict_mode_raises():
    set_strict(True)
    try:
        with pytest.raises(ValueError, match="unknown column"):
            people().sort("nope")
    finally:
        set_strict(False)


def test_csv(tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,name,id\n1,"a ""q"", b",x\n2,"line\nbreak",\n', encoding="utf-8")
    t = CSVReader().read_file(str(path)).unwrap()
    assert t.headers == ["id", "name", "id_2"] and t.source() == "in.csv"
    assert t.records() == [["1", 'a "q", b', "x"], ["2", "line\nbreak", ""]]
    assert [c.len() for c in CSVReader().read_file_stream(str(path), 1)] == [1, 1]
    out = tmp_path / "out.csv"
    CSVWriter(separator=";").write_file(str(out), t)
    assert CSVReader(separator=";").read_file(str(out)).unwrap().records() == t.records()
    assert to_string(tl.new(["a"], [["x,y"]])) == 'a\n"x,y"\n'
    assert CSVReader(header=False).read_string("1,2\n3,4\n").unwrap().headers == ["col_0", "col_1"]
    assert CSVReader().with_header_names("p").read_string("1,2\n").unwrap().records() == [["1"]]
    assert CSVReader().read_string("a,b\n1\n").is_err()


def test_json_files(tmp_path):
    text = '[{"b":1.10,"a":"x"},{"c":{"k":[]},"b":12345678901234567890}]'
    t = JSONReader().read_string(text).unwrap()
    assert t.headers == ["b", "a", "c"] and t.records() == [["1.10", "x", ""], ["12345678901234567890", "", '{"k":[]}']]
    assert JSONReader(sorted_headers=True).read_string(text).unwrap().headers == ["a", "b", "c"]
    assert JSONReader(flatten=True).read_string(text).unwrap().headers == ["b", "a", "c.k"]
    assert JSONReader(mapping={"z": ".c.k", "y": ".b"}).read_string(text).unwrap().records() == [["1.10", ""], ["12345678901234567890", "[]"]]
    assert JSONReader(ndjson=True).read_string('{"a":1}{"a":2}\n').unwrap().col("a") == ["1", "2"]
    assert JSONReader().read_string("[1]").is_err() and JSONReader(flatten=True, mapping={"a": ".a"}).read_string("[]").is_err()
    assert JSONWriter().to_string(tl.new(["b", "a"], [["<", "1"]])) == '[{"a":"1","b":"<"}]' and JSONWriter().to_string(tl.new(["a"], [])) == "[]"


def test_workbooks(tmp_path):
    import zipfile

    from tabloom.sources.workbook import ExcelReader, sheet_names

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    path = tmp_path / "b.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>id</t></si><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>x</t></is></c><c r="C3"><v>5</v></c></row></sheetData></worksheet>')
    t = ExcelReader().read_file(str(path)).unwrap()
    assert t.headers == ["id", "name", ""] and t.records() == [["", "", ""], ["", "x", "5"]]
    assert sheet_names(str(path)) == ["One"] and ExcelReader(sheet="No").read_file(str(path)).is_err()
    assert [c.records() for c in ExcelReader().read_file_stream(str(path), 5)] == [[["", ""], ["", "x"]]]


def test_file_stream_runs_a_step_for_each_batch(spark, tmp_path):
    from tabloom.streaming.chunks import file_stream, for_each_batch

    spark.range(10).selectExpr("id", "cast(id % 2 as string) as k").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = for_each_batch(file_stream(str(tmp_path / "in"), "id long, k string"), step.group_by_agg(["k"], [("n", tl.Count("id"))]), lambda t, i: seen.append(sorted(t.records())), str(tmp_path / "cp"), "id")
    q.awaitTermination(60)
    assert seen == [[["0", "5"], ["1", "5"]]]


cells = st.lists(st.sampled_from(["", "1", "2.5", "x", "-3"]), min_size=1, max_size=14)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cells, st.integers(1, 4))
def test_order_operators_match_plain_python_across_slices(monkeypatch, values, n):
    monkeypatch.setattr(ordered, "SLICE", 1)
    t = tl.new(["a"], [[v] for v in values])
    assert t.lag("a", "p", n).col("p") == ([""] * n + values)[: len(values)]
    assert t.lead("a", "p", n).col("p") == (values + [""] * n)[n : n + len(values)]
    carried, want = "", []
    for v in values:
        carried = v or carried
        want.append(carried)
    assert t.fill_forward("a").col("a") == want
    assert t.rolling_agg("j", n, tl.StringJoin("a", ",")).col("j") == [",".join(v for v in values[max(0, i - n + 1) : i + 1] if v) for i in range(len(values))]
    assert t.add_row_index("i").col("i") == [str(i) for i in range(len(values))]


def odd_frame(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, None, None), (1, "", 0, nan), (2, "a", 1, -0.0), (3, "ab", -7, 2.5), (4, "b", 1 << 60, inf), (5, "a", 1, None), (6, "1", 3, 1e-7)]
    return spark.createDataFrame(rows, "i long, s string, n long, d double")


def changed(t):
    """The same cells without the frame's own columns."""
    for c in t.headers:
        t = t.map_expr(c, lambda x: F.concat(x, F.lit("")))
    return t


def test_filters_and_numbers_of_a_frames_own_columns_are_those_of_its_cells(spark):
    from tabloom.functions import predicates as p

    own = from_frame(odd_frame(spark), "i")
    cells = changed(own)
    assert any("__raw" in c for c in own._df.columns) and not any("__raw" in c for c in cells._df.columns)
    tests = [f(c, v) for f in (p.eq, p.ne, p.contains, p.prefix, p.suffix) for c in ("s", "n", "none") for v in ("", "a", "1")] + [f(c) for f in (p.empty, p.not_empty) for c in "snd"]
    for test in [*tests, *(p.not_(x) for x in tests), p.or_(p.eq("s", "a"), p.not_(p.contains("s", "b")))]:
        assert own.where(test).records() == cells.where(test).records()
    assert own.drop_empty().records() == cells.drop_empty().records() and own.drop_empty("d", "s").records() == cells.drop_empty("d", "s").records()
    made = [t.add_col_float("sum", numeric.add("n", "d")).add_col_float("twice", numeric.mul_const("n", 2)).bin("n", "bin", [tl.BinDef(1, "low"), tl.BinDef(5, "high")]).rank("n", "rank").records() for t in (own, cells)]
    assert made[0] == made[1] and made[0][2][4:] == ["1", "2", "high", "3"]
    assert own.rename_many({"s": "n", "n": "s"}).where(p.eq("s", "1")).col("i") == ["2", "5"]


def test_filters_reach_the_scan(spark, tmp_path):
    odd_frame(spark).write.parquet(f"file://{tmp_path}/t")
    t = from_frame(spark.read.parquet(f"file://{tmp_path}/t"), "i")
    plan = t.drop_empty("n").where(t.ne("s", "a")).where(t.prefix("s", "b"))._df._jdf.queryExecution().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line).split("PushedFilters")[1]
    assert "IsNotNull(n)" in pushed and "StringStartsWith(s,b)" in pushed


@pytest.mark.parametrize("middle", [ordered.MIDDLE, 3])
def test_medians_are_exact(spark, monkeypatch, middle):
    import numpy as np

    monkeypatch.setattr(ordered, "MIDDLE", middle)
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 3001):
        x, y = rng.normal(0, 5, n), rng.integers(0, 4, n).astype(float)
        df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y, strict=True)], "x double, y double, z double").repartition(3)
        got = ordered.medians(df, {c: F.col(c) for c in "xyz"})
        assert got == {"x": pytest.approx(np.median(x), rel=1e-12), "y": np.median(y), "z": None}
    t = from_frame(spark.range(11).select((F.col("id") * 1.5).alias("v"), F.lit("x").alias("w")))
    assert S.median_col(t, "v") == 7.5 and S.median_col(t, "w") == 0.0 and S.mean_col(t, "v") == 7.5 and S.count_col(t, "w") == 11 and S.min_col(t, "w") == 0.0


def test_inference_and_ranks_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICES", 2)
    cells = ["1"] * 9000 + ["2.5"] + ["3"] * 4000 + ["yes"] + ["1"] * 9000
    t = from_frame(spark.createDataFrame([(i, c, "1" if i % 2 else "no") for i, c in enumerate(cells)], "i long, v string, b string").repartition(5), "i")
    found = S.infer(t).cols()
    monkeypatch.undo()
    assert found == S.infer(t).cols() and found["i"] == S.ColType.INT
    df = spark.createDataFrame([(float(i % 500),) for i in range(3000)], "x double")
    for up in (True, False):
        got = ordered.dense_rank(df, "x", "r", up, rows=70).distinct().collect()
        assert sorted((r["x"], r["r"]) for r in got) == [(float(i), i + 1 if up else 500 - i) for i in range(500)]


def test_limits_raise(monkeypatch):
    from tabloom import table

    monkeypatch.setattr(table, "NAMES", 2)
    monkeypatch.setattr(S, "VALUES", 2)
    t = tl.new(["a", "b"], [["x", "1"], ["y", "2"], ["z", "3"]])
    for run in (lambda: t.pivot("b", "a", "b"), lambda: t.transpose(), lambda: t.group_by("a"), lambda: S.freq_map(t, "a")):
        with pytest.raises(ValueError, match="more than 2"):
            run()


def test_slices_of_slices(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE", 3)
    monkeypatch.setattr(ordered, "GROUP", 2)
    t = from_frame(spark.range(500).select("id", F.when(F.col("id") % 90 == 7, F.col("id")).alias("v")).repartition(4), "id")
    t = t.cum_sum("id", "sum").fill_forward("v").add_row_index("place")
    rows = t.select("id", "sum", "v", "place").records()
    last = ""
    for i, (a, s, v, p) in enumerate(rows):
        last = str(i) if i % 90 == 7 else last
        assert (a, s, v, p) == (str(i), str(i * (i + 1) // 2), last, str(i))


def python_nodes(t):
    return t._df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")


def test_python_functions_in_a_row_share_a_worker():
    t = people().add_col_int("n", lambda r: len(r["name"])).add_col_float("x", lambda r: int(r["n"]) / 2e6).map("city", lambda c: c.upper() if c != "Paris" else None)
    t = t.add_col("seen", lambda r: "/".join(r.values())).add_col("true", lambda r: r["name"] == "Bob").add_col("none", lambda r: None).add_col_int("two", lambda r: 2.0)
    number = t.add_col_float("y", lambda r: 2 if r["name"] == "Ann" else None)
    t = number.transform(lambda r: {"name": r["city"] + r["x"], "n": None, "two": r["none"] + "!", "other": "?"} if r["age"] else None)
    assert t.headers == ["name", "city", "age", "n", "x", "seen", "true", "none", "two", "y"]
    assert t.records() == [
        ["BERLIN0.0000015", "BERLIN", "30", "3", "0.0000015", "Ann/BERLIN/30/3/0.0000015", "false", "", "!", "2"],
        ["0.0000015", "", "25", "3", "0.0000015", "Bob//25/3/0.0000015", "true", "", "!", ""],
        ["Cid", "BERLIN", "", "3", "0.0000015", "Cid/BERLIN//3/0.0000015", "false", "", "2", ""],
    ]
    assert python_nodes(t) == 1
    assert [tuple(r) for r in number._df.select("__raw_n", "__raw_x", "__raw_two", "__raw_y").collect()] == [(3, 1.5e-6, 2, 2.0), (3, 1.5e-6, 2, None), (3, 1.5e-6, 2, None)]


def test_functions_after_other_steps_see_their_cells():
    t = people().add_col("a", lambda r: r["age"] + "a").rename("a", "b").drop("city").add_col("c", lambda r: r["b"] + "/".join(r.headers()))
    assert t.records()[1] == ["Bob", "25", "25a", "25aname/age/b"]
    m = people().thaw()
    m.add_col("a", lambda r: r["age"] + "a").map("a", str.upper).set(0, "a", "set").add_col("c", lambda r: r["a"] + "c")
    assert [r[-2:] for r in m.freeze().records()] == [["set", "setc"], ["25A", "25Ac"], ["A", "Ac"]]


@pytest.mark.parametrize(("x", "text"), [(1e22, "1" + "0" * 22), (1.5e-7, "0.00000015"), (-0.0, "-0"), (12345678.0, "12345678"), (float("inf"), "+Inf"), (float("-inf"), "-Inf"), (float("nan"), "NaN"), (0.1, "0.1")])
def test_floats_of_python_functions_print_as_those_of_expressions(x, text):
    t = people().add_col_float("p", lambda r: x).add_col_float("e", F.lit(x)).add_col("seen", lambda r: r["p"])
    assert [r[-3:] for r in t.records()] == [[text] * 3] * 3


def least(t, n, seed):
    """The ids of the n rows with the least random numbers, in their order."""
    return [r[0] for r in t._df.withColumn("u", F.rand(seed)).orderBy("u").limit(n).select("id").collect()]


@pytest.mark.parametrize("n", [0, 3, 1_000, 1_001, 7_777, 19_999])
def test_samples_are_the_rows_with_the_least_random_numbers(spark, n):
    t = from_frame(spark.range(0, 20_000, 1, 4), "id")
    drawn = t.sample(n, seed=5)
    assert drawn.col("id") == least(t, n, 5)
    if n > ordered.DRAWN:  # no task has all the rows
        plan = drawn._df._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "Limit" not in plan


def test_samples_of_equal_random_numbers_and_of_bounds_that_miss(spark):
    df = spark.range(0, 5_000, 1, 4).withColumn("__ord", F.col("id"))
    for by in (F.lit(0.25), (F.col("id") % 2) / 2, F.lit(0.0), F.lit(0.999), F.col("id") / 5_000 / 1_000, 0.9 + F.col("id") / 50_000):
        found = ordered.drawn(df, "__ord", by.cast("double"), 2_000, 5_000)
        want = [r[0] for r in df.withColumn("u", by).orderBy("u", "__ord").limit(2_000).select("id").collect()]
        assert sorted(r[0] for r in found.select("id").collect()) == sorted(want)


def test_mutable_samples_of_all_rows_are_shuffled(spark):
    m = from_frame(spark.range(0, 5_000, 1, 4), "id").thaw()
    found = m.sample(9_000, seed=3).freeze()
    assert found.col("id") == least(from_frame(spark.range(0, 5_000, 1, 4), "id"), 5_000, 3)
    assert "Limit" not in found._df._jdf.queryExecution().executedPlan().toString()
