"""Results sent to the console, to CSV and to JSON, and read back; settings read from a file."""

import pytest

from loanbook.config import DEFAULT, TapeConfig
from loanbook.operators import checks
from loanbook.plans.sql_runner import run_query
from loanbook.sinks import export


def plain(df):
    """Rows in any order; an empty text and a missing one are the same in CSV."""
    return sorted((tuple(None if v == "" else v for v in row) for row in df.collect()), key=repr)


@pytest.fixture(scope="module")
def exported(spark, loans, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("export"))
    # More rows than the page takes, the last ones first.
    segments = spark.range(50, 0, -1).selectExpr("'s' || id AS segment", "cast(id AS int) AS position")
    export.export_dashboard(loans, f"{folder}/csv")
    written = export.export_page(loans, f"{folder}/json", segments, evaluation=run_query("portfolio_summary", loans))
    return folder, written, segments


@pytest.mark.parametrize("name", list(export.CSV_TABLES))
def test_every_csv_table_reads_back(spark, loans, exported, name):
    table = export.CSV_TABLES[name](loans)
    back = export.read_result(spark, f"{exported[0]}/csv/{name}", table.schema)
    assert back.columns == table.columns and plain(back) == plain(table)
    assert plain(table) or name == "risk_segments"  # no segment is large enough at this scale


def test_the_loan_extract_reads_back(spark, loans, exported):
    table = run_query("loan_detail", loans)
    back = export.read_result(spark, f"{exported[0]}/csv/loans_detail", table.schema)
    assert plain(back) == plain(table) != []


@pytest.mark.parametrize("name", list(export.JSON_TABLES))
def test_every_json_table_reads_back(spark, loans, exported, name):
    table = export.JSON_TABLES[name](loans)
    back = export.read_result(spark, f"{exported[0]}/json/{name}", table.schema, "json")
    assert sorted(back.collect(), key=repr) == sorted(table.collect(), key=repr) != []


def test_page_holds_evaluation_and_the_first_segments(spark, loans, exported):
    folder, written, segments = exported
    assert set(written) == {*export.JSON_TABLES, "evaluation", "risk_segments"}
    back = export.read_result(spark, f"{folder}/json/risk_segments", segments.schema, "json").collect()
    assert [r["position"] for r in back] == list(range(1, min(export.PAGE_SEGMENTS, segments.count()) + 1))
    summary = run_query("portfolio_summary", loans)
    assert export.read_result(spark, f"{folder}/json/evaluation", summary.schema, "json").collect() == summary.collect()


def test_console_shows_all_rows_under_their_names(spark, capsys):
    df = spark.createDataFrame([(k, None if k % 2 else f"s{k}") for k in range(50)], "n int, s string").repartition(3)
    export.show_or_write(df)
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "n\ts"
    assert sorted(lines[1:]) == sorted(f"{k}\t{'' if k % 2 else f's{k}'}" for k in range(50))


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_results_go_to_a_folder(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, None)], "n int, s string")
    export.show_or_write(df, fmt, f"{tmp_path}/out")
    export.show_or_write(df, fmt, f"{tmp_path}/out")  # replaces, does not add
    assert sorted(export.read_result(spark, f"{tmp_path}/out", df.schema, fmt).collect()) == sorted(df.collect())


def test_missing_path_and_unknown_format_are_refused(spark, tmp_path):
    df = spark.range(1)
    with pytest.raises(ValueError):
        export.show_or_write(df, "csv")
    with pytest.raises(ValueError):
        export.show_or_write(df, "xml", f"{tmp_path}/out")
    with pytest.raises(ValueError):
        export.read_result(spark, f"{tmp_path}/out", df.schema, "xml")


def test_settings_from_a_file_change_what_is_judged(loans, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "tape.yaml"
    path.write_text("max_null_pct_default: 99.5\nmin_vintages: 100000\nmax_null_pct_warning:\n  ltv: 50.0\n")
    cfg = TapeConfig.from_yaml(str(path))
    assert (cfg.max_null_pct_default, cfg.max_null_pct_warning) == (99.5, {"ltv": 50.0})
    assert cfg.columns == DEFAULT.columns and cfg.min_loans_per_pool == DEFAULT.min_loans_per_pool
    status = lambda c: {r["check_name"]: r["status"] for r in checks.load_validation(loans, c).collect()}
    changed = {k for k, v in status(cfg).items() if status(DEFAULT).get(k) != v}
    assert changed

    path.write_text("")
    assert TapeConfig.from_yaml(str(path)) == DEFAULT
    path.write_text("no_such_setting: 1\n")
    with pytest.raises(KeyError):
        TapeConfig.from_yaml(str(path))


def test_exports_read_loans_that_were_derived_once(spark, monkeypatch):
    """The loans are written down in methods small enough to be compiled before seven exports read them."""
    from loanbook import registry
    from loanbook.functions import ordered

    limits, exported = [], []
    loans, kept = spark.range(3), spark.range(2)
    monkeypatch.setattr(registry, "staged", lambda df: limits.append((df, spark.conf.get(ordered.METHOD_LIMIT_CONF))) or kept)
    monkeypatch.setattr(registry, "_new_folder", lambda spark, name: "/nowhere")
    monkeypatch.setattr(registry.testtables, "loans", lambda spark, sf_dir: loans)
    monkeypatch.setattr(registry.portfolio, "vintage_comparison", lambda df: df)
    monkeypatch.setattr(registry.export, "export_dashboard", lambda df, folder: exported.append(df))
    monkeypatch.setattr(registry.export, "read_result", lambda *a: None)
    registry.exported_csv(spark, "/nowhere")
    assert limits == [(loans, ordered.METHOD_LIMIT)] and exported == [kept]
