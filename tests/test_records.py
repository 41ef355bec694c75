"""CSV records read in splits, against Spark's reader of whole files."""

import random

import pytest
from build import rows
from fourthtick import schemas
from fourthtick.sources import records, storage

COLUMNS = ["game_id", "season", "week", "home_team", "away_team", "game_date"]
NAMES = schemas.CSV_ORDER["plays"]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written(folder, seed, n, end="\n"):
    """A plays file whose texts hold quotes, commas, line breaks and lines of quotes only."""
    draw = random.Random(seed)
    pieces = ["go", '""', ",", "\n", "\n\n", '""\n""', " ", "é", "x" * 300, '"",""', "\\", "end."]
    lines = [",".join("desc" if c == "description" else c for c in NAMES)]
    for i in range(n):
        text = "".join(draw.choices(pieces, k=draw.randrange(9)))
        cells = {"game_id": f"G{i % 7}", "play_id": str(i), "qtr": "x" if i % 50 == 9 else "2"}
        cells["description"] = f'"{text}"' if text or i % 2 else ""
        cells["timestamp_utc"] = "2024-01-02T03:04:05.000000"
        line = ",".join(cells.get(c, "") for c in NAMES)
        lines.append(line + ",more" if i % 40 == 3 else line)
        if i % 30 == 0:
            lines.append("")
    (folder / "plays.csv").mkdir(exist_ok=True)
    path = folder / "plays.csv" / f"part-{seed}.csv"
    path.write_text(end.join(lines) + (end if seed % 2 else ""), newline="")


def whole_files(spark, folder):
    schema = schemas.csv_schema("plays").add("bad", "string")
    return spark.read.schema(schema).csv(
        f"{folder}/plays.csv", header=True, enforceSchema=False, multiLine=True, escape='"',
        mode="PERMISSIVE", columnNameOfCorruptRecord="bad",
    )


def test_equal_to_whole_files(spark, tmp_path, small_splits):
    written(tmp_path, 1, 700)
    written(tmp_path, 2, 300)
    found = records.csv_records(spark, f"{tmp_path}/plays.csv", schemas.csv_schema("plays").fieldNames())
    assert spark.read.text(f"{tmp_path}/plays.csv").rdd.getNumPartitions() > 30
    got = records.parsed_records(found, schemas.csv_schema("plays"), "bad")
    want = whole_files(spark, tmp_path)
    assert got.dtypes == want.dtypes
    assert sorted(rows(got.drop("bad")), key=repr) == sorted(rows(want.drop("bad")), key=repr)
    assert want.where("desc LIKE '%\n%'").count() > 300
    # The same rows are bad, with their whole text.
    bad = {r["bad"].split(",")[1] for r in got.collect() if r["bad"] is not None}
    assert bad == {r["bad"].split(",")[1] for r in want.collect() if r["bad"] is not None}
    assert len(bad) > 30
    # Both files have rows of the same play_id: rows are counted, not ids.
    n_bad = sum(r["bad"] is not None for r in want.collect())
    assert len(rows(storage.rejected_csv_rows(spark, str(tmp_path), "plays"))) == n_bad


def test_lines_that_end_in_two_characters(spark, tmp_path, small_splits):
    (tmp_path / "games.csv").write_text(
        ",".join(COLUMNS) + "\r\n" + "".join(f'G{i},2024,1,"H\r\nB",A,2024-01-02\r\n' for i in range(300)),
        newline="",
    )
    got = rows(storage.read_csv_table(spark, str(tmp_path), "games").select("game_id", "home_team", "away_team"))
    assert sorted(got) == sorted((f"G{i}", "H\r\nB", "A") for i in range(300))


def test_single_lines_are_not_grouped(spark, tmp_path):
    written(tmp_path, 1, 50)
    frame = records.csv_records(spark, f"{tmp_path}/plays.csv", schemas.csv_schema("plays").fieldNames())
    text = frame._jdf.queryExecution().toString()
    assert "isnull(opened" in text and "isnotnull(opened" in text


def test_damaged_files_are_named(spark, tmp_path):
    folder = tmp_path / "games.csv"
    folder.mkdir()
    head = ",".join(COLUMNS)
    (folder / "a.csv").write_text(f'{head}\nG1,2024,1,"H,A,2024-01-02\nG2,2024,1,H,A,2024-01-02\n')
    with pytest.raises(ValueError, match="not closed at the end of .*a.csv"):
        storage.read_csv_table(spark, str(tmp_path), "games")
    (folder / "a.csv").write_text("game_id,week\nG1,1\n")
    with pytest.raises(ValueError, match="a.csv has the columns"):
        storage.read_csv_table(spark, str(tmp_path), "games")
    (folder / "a.csv").write_text(head + "\n")
    assert rows(storage.read_csv_table(spark, str(tmp_path), "games")) == []
    (folder / "a.csv").write_text("")
    assert rows(storage.read_csv_table(spark, str(tmp_path), "games")) == []
