"""CSV scan, file checks, sinks and the whole ETL on files."""

import time

import pytest
from pyspark.sql import functions as F

from casewatch import presets, session
from casewatch.operators import align, clean
from casewatch.operators.dedupe import dedupe_cases
from casewatch.plans import etl
from casewatch.sources import catalog, files, heads, release, sinks


def write(path, content, encoding="utf-8"):
    path.write_bytes(content.encode(encoding))
    return str(path)


def cells(df):
    return [tuple(r) for r in df.drop(files.ROW_ORDER).collect()]


def test_csv_short_long_and_surplus(spark, tmp_path):
    path = write(tmp_path / "x.csv", 'a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,11,12,\n"x,y","q""q",z\n')
    assert cells(files.read_csv(spark, path)) == [
        ("1", "2", "3"), ("4", "5", None), ("x,y", 'q"q', "z"),
    ]


def test_csv_delimiter_bom_and_na(spark, tmp_path):
    path = write(tmp_path / "x.csv", "﻿año;b\nNA;  x \nnull;\n")
    df = files.read_csv(spark, path)
    assert df.columns[:2] == ["año", "b"]
    assert cells(df) == [(None, "  x "), (None, None)]


def test_csv_latin1(spark, tmp_path):
    path = write(tmp_path / "x.csv", "año,b\nNariño,1\n", "latin-1")
    df = files.read_csv(spark, path)
    assert df.columns[0] == "año" and cells(df) == [("Nariño", "1")]


def test_csv_folder_of_mixed_encodings(spark, tmp_path):
    """Each file by its own encoding, also where the head of a Latin-1 file is plain ASCII."""
    late = "id,name\n" + "".join(f"{i},plain\n" for i in range(20_000)) + "late,Nariño\n"
    for name, content, encoding in (
        ("a.csv", "id,name\na,Bogotá\n", "utf-8"), ("b.csv", "id,name\nb,Bogotá\n", "latin-1"), ("c.csv", late, "latin-1"),
        ("d.csv", "id,name\nd,Tumaco\n", "utf-8-sig"), ("e.csv", "año;id\n2024;e\n", "latin-1"), ("f.csv", "", "utf-8"),
    ):
        write(tmp_path / name, content, encoding)
    df = files.read_csv(spark, str(tmp_path))
    got = {r["id"]: (r["name"], r["año"]) for r in df.filter("id >= 'a'").collect()}
    assert got == {"a": ("Bogotá", None), "b": ("Bogotá", None), "late": ("Nariño", None), "d": ("Tumaco", None), "e": (None, "2024")}
    assert df.count() == 20_005


def test_csv_bodies_are_read_once(spark, tmp_path):
    write(tmp_path / "a.csv", "id,v\n1,é\n")
    write(tmp_path / "b.csv", "id,v\n2,é\n", "latin-1")
    plan = files.read_csv(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2  # one scan for each group, a file in one of them


class Counted:
    def __init__(self, content):
        self.content, self.read_bytes = content, 0

    def read(self, n):
        part = self.content[self.read_bytes:self.read_bytes + n]
        self.read_bytes += len(part)
        return part


def test_heads_read_no_more_than_asked():
    stream = Counted(b"x" * 10**6)
    assert heads.read_head(stream, 500, whole_line=False) == b"x" * 500 and stream.read_bytes == 500
    wide = Counted(b"h" * 100_000 + b"\n" + b"x" * 10**6)
    assert heads.header_line(heads.read_head(wide, 500, whole_line=True)) == ("h" * 100_000, True)
    assert wide.read_bytes < 200_000


def test_raw_files_of_any_size(spark, tmp_path):
    """A file of 3 GB, sparse on disk, is no row that holds its content."""
    with open(tmp_path / "big one.csv", "wb") as f:
        f.write(b"a,b\n1,2\n")
        f.truncate(3 * 2**30)
    write(tmp_path / "page.csv", "<!DOCTYPE html>" + "x" * 200)
    got = {r["filename"]: (r["size_bytes"], r["is_valid"]) for r in catalog.raw_files(spark, str(tmp_path)).collect()}
    assert got == {"big one.csv": (3 * 2**30, True), "page.csv": (215, False)}


def test_csv_keeps_row_order(spark, tmp_path):
    path = write(tmp_path / "x.csv", "a\n" + "\n".join(str(i) for i in range(500)) + "\n")
    ordered = files.read_csv(spark, path).repartition(5).orderBy(files.ROW_ORDER)
    assert [int(r["a"]) for r in ordered.collect()] == list(range(500))


def test_csv_folder_order_and_headers(spark, tmp_path):
    """Files by path whatever their sizes; columns by name whatever their order."""
    write(tmp_path / "a.csv", "id,v\na0,0\na1,1\nshared,first\n")
    write(tmp_path / "b.csv", "id,v\n" + "\n".join(f"b{i},{i}" for i in range(200)) + "\nshared,second\n")
    write(tmp_path / "c.csv", "v;id;w\n7;c;x\n")
    df = files.read_csv(spark, str(tmp_path)).orderBy(files.ROW_ORDER)
    got = [(r["id"], r["v"], r["w"]) for r in df.collect()]
    assert got == [
        ("a0", "0", None), ("a1", "1", None), ("shared", "first", None),
        *[(f"b{i}", str(i), None) for i in range(200)], ("shared", "second", None), ("c", "7", "x"),
    ]
    cases = df.withColumns({"CONSECUTIVE": F.col("id"), "enfermedad": F.lit("D"), "COD_EVE": F.lit(1)})
    first = dedupe_cases(cases, order_by=[files.ROW_ORDER], copies="n").filter("id = 'shared'").collect()
    assert [(r["v"], r["n"]) for r in first] == [("first", 2)]


def test_ordered_dedupe_sorts_no_rows(spark):
    df = spark.range(100).selectExpr(
        "id % 9 CONSECUTIVE", "'D' enfermedad", "1 COD_EVE", "cast(id as decimal(38,0)) place", "cast(id as string) v")
    plan = dedupe_cases(df, order_by=["place"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan


@pytest.mark.parametrize("kind", ["int", "decimal(18,0)", "decimal(38,0)", "double"])
def test_tied_order_keeps_one_row_per_key(spark, kind):
    df = spark.range(300).selectExpr(
        "id % 100 CONSECUTIVE", "'D' enfermedad", "1 COD_EVE", f"cast(nullif(id % 3, 2) as {kind}) place", "cast(id as string) v")
    same = df.unionByName(df.filter("CONSECUTIVE < 50"))
    got = dedupe_cases(same, order_by=["place"], copies="n").collect()
    assert sorted(r["CONSECUTIVE"] for r in got) == list(range(100))
    assert {(r["CONSECUTIVE"], r["n"]) for r in got} == {(i, 6 if i < 50 else 3) for i in range(100)}
    assert all(r["place"] is None for r in got)  # null is the first


def test_tied_order_without_id(spark):
    df = spark.createDataFrame([(None, "D", 1, 1, "a"), (None, "D", 1, 1, "b"), (None, "D", 1, 1, "a"), (None, "D", 1, 2, "b")],
                               "CONSECUTIVE string, enfermedad string, COD_EVE int, place long, v string")
    got = sorted((r["v"], r["place"], r["n"]) for r in dedupe_cases(df, order_by=["place"], copies="n").collect())
    assert got == [("a", 1, 2), ("b", 1, 2)]


def test_dedupe_forces_no_join(spark):
    df = spark.range(100).selectExpr("id % 9 CONSECUTIVE", "'D' enfermedad", "1 COD_EVE", "id place")
    plan = dedupe_cases(df, order_by=["place"])._jdf.queryExecution().logical().toString()
    assert "hint" not in plan.lower()


def test_file_validation(spark):
    rows = [
        ("a.csv", b"x" * 99), ("a.csv", b"x" * 100), ("a.XLSX", b"PK" + b"x" * 100),
        ("a.xlsx", b"x" * 200), ("a.csv", b"<!DOCTYPE HTML>" + b"x" * 100),
        ("a.csv", b"x" * 500 + b"<html>"), ("a.txt", b"<html>" + b"x" * 100),
        ("a.csv", b"\xff\xfe" + b"<HTML>" + b"x" * 100),
    ]
    df = spark.createDataFrame(rows, "n string, c binary")
    got = df.select(catalog.is_valid_file(F.col("n"), F.col("c")).alias("v")).collect()
    assert [r["v"] for r in got] == [False, True, True, False, False, True, True, False]


def test_manifest(spark, tmp_path):
    big, page = "a,b\n" * 400, "<html>" + "x" * 200
    write(tmp_path / "sivigila_dengue_medata_2024.csv", big)
    write(tmp_path / "sivigila_chikungunya_medata_2024.csv", page)
    write(tmp_path / "Datos_2024_210.xlsx", "PK" + "x" * 200)
    found = catalog.raw_files(spark, str(tmp_path))
    got = catalog.ingest_manifest(catalog.source_catalog(spark, 2024), found)
    status = {r["filename"]: (r["status"], r["size_bytes"]) for r in got.collect()}
    assert status["sivigila_dengue_medata_2024.csv"] == ("cached", 1600)
    assert status["sivigila_chikungunya_medata_2024.csv"][0] == "invalid_content"
    assert status["Datos_2024_210.xlsx"][0] == "downloaded"
    assert status["Datos_2024_490.xlsx"] == ("failed_request", 0)
    log = spark.createDataFrame(
        [("Datos_2024_210.xlsx", 503, "text/html")], "filename string, http_status int, content_type string"
    )
    forced = catalog.ingest_manifest(catalog.source_catalog(spark), found, log, force=True)
    status = {r["filename"]: r["status"] for r in forced.collect()}
    assert status["Datos_2024_210.xlsx"] == "failed_http"
    assert status["sivigila_dengue_medata_2024.csv"] == "downloaded"
    assert catalog.source_catalog(spark, 1999).isEmpty()


def test_csv_sink_has_bom(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("x", 1)], "a string, b int"), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfa,b\n")


def test_per_disease_folders(spark, tmp_path):
    df = spark.createDataFrame([("MALARIA VIVAX", 1), ("DENGUE", 2), (None, 3)], "enfermedad string, v int")
    sinks.write_per_disease(df, str(tmp_path / "out"))
    names = {p.name for p in (tmp_path / "out").glob("slug=*")}
    assert names == {"slug=malaria_vivax", "slug=dengue"}


def test_load_append_and_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    sinks.load_table(df, path)
    sinks.load_table(df, path, mode="append")
    assert spark.read.parquet(path).filter("x is null").count() == 2
    sinks.load_table(df, path)
    assert spark.read.parquet(path).count() == 2


def test_read_processed(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_processed(spark, str(tmp_path), "clean")
    write(tmp_path / "clean.csv", "a\n1\n")
    assert files.read_processed(spark, str(tmp_path), "clean").dtypes == [("a", "string")]


DENGUE = """Código caso,Fecha de notificación,SEMANA,YEAR,edad,uni_med,genero,DEPARTAMENTO,municipio,pac_hos,con_fin,cod_dpto_o
1,2024-01-03,1,2024,30,1,Femenino,Nariño,Pasto,1,1,52.0
1,2024-01-03,1,2024,31,1,M,Nariño,Pasto,2,1,52.0
2,05/01/2024,1,2024,6,2,M,Nariño,Pasto,2,2,52
,2024-01-09,2,2024,40,1,F,SIN DATO,Pasto,1,1,52
,2024-01-09,2,2024,40,1,F,SIN DATO,Pasto,1,1,52
3,2024-01-09,99,2024,40,1,F,Cauca,Popayan,1,1,19
"""
MALARIA = """id;semana;departamento;municipio;edad
7;1;Chocó;Quibdó;12
8;1;Chocó;Quibdó;13
"""


def test_full_etl(spark, tmp_path):
    out = tmp_path / "out"
    sources = [
        etl.Source("Dengue", 210, 2024, "medata", write(tmp_path / "dengue.csv", DENGUE)),
        etl.Source("Malaria", 490, 2023, "ins", write(tmp_path / "malaria.csv", MALARIA)),
        etl.Source("Zika", 895, 2024, "ins", str(tmp_path / "absent.csv")),
    ]
    result = etl.run_etl(spark, sources, str(out), csv_copies=True)
    clean = {r["CONSECUTIVE"]: r for r in spark.read.parquet(f"{out}/clean.parquet").collect()}
    assert set(clean) == {"1", "2", "7", "8"}
    first = clean["1"]
    assert first["EDAD"] == 30 and first["SEXO"] == "F" and first["COD_DPTO_O"] == "52"
    assert first["Departamento_ocurrencia"] == "NARINO" and first["COD_EVE"] == 210
    assert clean["2"]["FEC_NOT"].month == 5 and clean["2"]["edad_anos"] == 0.5
    assert clean["7"]["ANO"] == 2023 and clean["7"]["enfermedad"] == "MALARIA"
    assert clean["7"]["SEXO"] == "SIN_DATO" and clean["7"]["source_file"] == "MALARIA.CSV"
    report = dict((r["metric"], r["value"]) for r in result.quality.collect())
    assert report["total_clean_rows"] == 4 and report["total_rejected_rows"] == 2
    assert report["duplicates_removed"] == 2 and report["total_aggregated_rows"] == 2
    assert report["nulls_FEC_NOT"] == 2 and report["rows_disease_DENGUE"] == 2
    weekly = {r["departamento"]: r for r in spark.read.parquet(f"{out}/serving/weekly").collect()}
    assert weekly["NARINO"]["total_casos"] == 2 and weekly["NARINO"]["fallecidos"] == 1
    audit = spark.read.parquet(f"{out}/audit").collect()
    assert [(r["clean_rows"], r["aggregated_rows"]) for r in audit] == [(4, 2)]
    columns = len(spark.read.parquet(f"{out}/clean.parquet").columns)
    assert columns == len(
        presets.CANONICAL_COLUMNS + presets.LINEAGE_COLUMNS + presets.DERIVED_COLUMNS
    ) == 37
    assert {p.name for p in (out / "clean_by_disease").glob("slug=*")} == {
        "slug=dengue", "slug=malaria"
    }
    assert (out / "quality.json").exists() and (out / "rejected.csv").exists()


def etl_sources(tmp_path, dengue=DENGUE):
    return [etl.Source("Dengue", 210, 2024, "medata", write(tmp_path / "dengue.csv", dengue)),
            etl.Source("Malaria", 490, 2023, "ins", write(tmp_path / "malaria.csv", MALARIA))]


def test_publish_is_all_or_nothing(spark, tmp_path, monkeypatch):
    """A job that stops between two artefacts leaves the release before it whole."""
    root = str(tmp_path / "root")
    etl.publish(spark, etl_sources(tmp_path), root)
    first = release.current(spark, root)
    more = DENGUE + "9,2024-01-09,2,2024,40,1,F,Cauca,Popayan,1,1,19\n"

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(sinks, "write_csv", stop)
        with pytest.raises(RuntimeError):
            etl.publish(spark, etl_sources(tmp_path, more), root)
    assert release.current(spark, root) == first and release.missing(spark, root).isEmpty()
    assert files.read_processed(spark, root, "clean").count() == 4
    assert sum(r["total_casos"] for r in files.read_processed(spark, root, "weekly").collect()) == 4
    assert len(list((tmp_path / "root" / "releases").iterdir())) == 2
    etl.publish(spark, etl_sources(tmp_path, more), root)
    assert release.current(spark, root) != first
    assert files.read_processed(spark, root, "clean").count() == 5
    assert spark.read.parquet(f"{root}/serving/clean").count() == 5
    assert [r["clean_rows"] for r in spark.read.parquet(f"{root}/audit").orderBy("loaded_at").collect()] == [4, 5]
    assert release.drop_others(spark, root) == 2
    assert release.missing(spark, root).isEmpty()


def test_a_lost_artefact_is_told(spark, tmp_path):
    root = str(tmp_path / "root")
    etl.publish(spark, etl_sources(tmp_path), root)
    lost = next((tmp_path / "root" / "releases").glob("*/weekly.parquet/part-*"))
    lost.write_bytes(b"")
    assert [r["file"].split("/")[0] for r in release.missing(spark, root).collect()] == ["weekly.parquet"]


def test_raw_sources_are_read_once(spark, tmp_path):
    """No plan reads the raw files but the one that stages them."""
    cases = etl.read_sources(spark, etl_sources(tmp_path))
    assert "csv" not in cases._jdf.queryExecution().executedPlan().toString().lower().replace(".csv", "")
    assert {(r["CONSECUTIVE"], r["ANO"]) for r in cases.filter("enfermedad = 'MALARIA'").collect()} == {("7", 2023), ("8", 2023)}


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["disease", "month", "city"]
    rows = [(d, m, c, 1) for d in ("A", "B") for m in range(1, 13) for c in ("x", "y")]
    schema = "disease string, month int, city string, n int"
    sinks.upsert_partitions(spark.createDataFrame(rows, schema), path, keys)
    before = {f for f in (tmp_path / "t").rglob("*.parquet")}
    got = sinks.upsert_partitions(spark.createDataFrame([("A", 3, "x", 9), ("C", 1, "x", 5)], schema), path, keys)
    want = {(d, m, c): n for d, m, c, n in rows} | {("A", 3, "x"): 9, ("C", 1, "x"): 5}
    assert {(r["disease"], r["month"], r["city"]): r["n"] for r in got.collect()} == want
    after = {f for f in (tmp_path / "t").rglob("*.parquet")}
    assert {f.parent for f in before - after} <= {f.parent for f in after - before}
    assert len({f.parent for f in after - before}) <= 2 and len(before & after) >= 10


def test_etl_without_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        etl.read_sources(spark, [etl.Source("D", 1, 2024, "s", str(tmp_path / "no.csv"))])


def test_etl_frees_its_disk(spark, tmp_path):
    """Staged tables and shuffle files are gone after the job; files with a line per case are compressed and read back whole."""
    made = session.scratch_count()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    result = etl.run_etl(spark, etl_sources(tmp_path), str(tmp_path / "out"), csv_copies=True)
    assert result.quality.count() and session.scratch_count() == made + 1  # the report
    assert spark.conf.get(key) == before
    for name in ("clean.csv", "clean_by_disease", "rejected.csv"):
        parts = list((tmp_path / "out" / name).rglob("part-*"))
        assert parts and all(p.name.endswith(".csv.gz") for p in parts)
    clean = spark.read.csv(str(tmp_path / "out" / "clean.csv"), header=True)
    assert {r["CONSECUTIVE"] for r in clean.collect()} == {"1", "2", "7", "8"}
    assert all(r["slug"] == r["enfermedad"].lower() for r in spark.read.csv(str(tmp_path / "out" / "clean_by_disease"), header=True).collect())


def test_shuffle_files_go_with_their_query(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files_left():
        return {n for n in disk.getAllFiles().mkString("|").split("|") if "shuffle_" in n}

    before, plain = files_left(), spark.range(1000).repartition(3)
    assert len(plain.collect()) == 1000 and files_left() - before
    with session.shuffles_dropped(spark):
        before, dropped = files_left(), spark.range(1000).repartition(3)
        assert len(dropped.collect()) == 1000
        until = time.monotonic() + 20
        while files_left() - before and time.monotonic() < until:
            time.sleep(0.1)
        assert not files_left() - before
        assert len(dropped.collect()) == 1000  # a second run makes them again


def test_derived_columns_do_not_travel_through_dedupe(spark, tmp_path):
    cases = etl.read_sources(spark, etl_sources(tmp_path))
    again = clean.with_derived(cases.drop(*presets.DERIVED_COLUMNS)).select(*cases.columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, cases.collect()))


def test_per_disease_files_need_no_shuffle(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("Dengue Grave", 1), ("Zika", 2), (None, 3)], "enfermedad string, v int")
    plain, plans = sinks.write_csv, []

    def watched(rows, *args, **named):
        plans.append(rows._jdf.queryExecution().logical().toString().lower())
        plain(rows, *args, **named)

    monkeypatch.setattr(sinks, "write_csv", watched)
    sinks.write_per_disease(df, str(tmp_path / "d"))
    assert len(plans) == 1 and "rebalance" not in plans[0]
    assert {(r["slug"], r["v"]) for r in spark.read.csv(str(tmp_path / "d"), header=True).collect()} == {("dengue_grave", "1"), ("zika", "2")}


def test_csv_rows_are_not_shuffled_to_find_their_place(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        write(tmp_path / name, "id,v\n1,é\n2,plain\n")
    with session.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):  # as for large files
        df = files.read_csv(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert cells(df.orderBy(files.ROW_ORDER)) == [("1", "é"), ("2", "plain")] * 2


def test_rows_are_staged_once_and_clean(spark, tmp_path, monkeypatch):
    """Raw rows, clean rows and the report are two tables, not three."""
    made, plain = [], session.materialize

    def counted(df, *args):
        made.append(df.columns)
        return plain(df, *args)

    monkeypatch.setattr(etl, "materialize", counted)
    monkeypatch.setattr(align, "materialize", counted)
    etl.run_etl(spark, etl_sources(tmp_path), str(tmp_path / "out"))
    assert len(made) == 2 and made[1] == ["metric", "value"]
    assert not set(presets.DERIVED_COLUMNS) & set(made[0])


def test_defaults_of_empty_columns_are_cleaned(spark, tmp_path):
    """The header has the columns, but no row of the source: the default goes through cleaning as a value would."""
    raw = "id;cod_eve;nom_eve;year;semana;departamento\n1;;;;1;Chocó\n2;NA;;;1;Chocó\n"
    sources = [etl.Source("Fiebre  amarilla é", 310, 1899, "ins", write(tmp_path / "a.csv", raw)),
               etl.Source("Dengue", 210, 2024, "ins", write(tmp_path / "b.csv", raw.replace("1;;;;", "1;7;x;2021;")))]
    got = {(r["source_file"], r["CONSECUTIVE"]): (r["COD_EVE"], r["Nombre_evento"], r["ANO"]) for r in etl.read_sources(spark, sources).collect()}
    assert got == {("A.CSV", "1"): (310, "FIEBRE AMARILLA E", None), ("A.CSV", "2"): (310, "FIEBRE AMARILLA E", None),
                   ("B.CSV", "1"): (7, "X", 2021), ("B.CSV", "2"): (None, None, None)}


def test_unique_places_need_no_content(spark):
    df = spark.range(500).selectExpr(
        "nullif(cast(id % 90 as string), '7') CONSECUTIVE", "if(id % 3 = 0, 'D', null) enfermedad", "1 COD_EVE",
        "cast(nullif(id, 13) as decimal(38,0)) place", "cast(id % 4 as string) v")
    unique = dedupe_cases(df, order_by=["place"], copies="n", unique=True)
    assert sorted(map(str, unique.collect())) == sorted(map(str, dedupe_cases(df, order_by=["place"], copies="n").collect()))
    plan = unique._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in plan and plan.count("Aggregate") == 2  # the keys; rows without an id


def test_wide_job_settings_hold_inside_only(spark):
    before = {k: spark.conf.get(k, None) for k in session.WIDE_ROWS}
    with pytest.raises(RuntimeError), session.wide_job(spark):
        assert all(spark.conf.get(k) == v for k, v in session.WIDE_ROWS.items())
        raise RuntimeError("stopped")
    assert {k: spark.conf.get(k, None) for k in session.WIDE_ROWS} == before
