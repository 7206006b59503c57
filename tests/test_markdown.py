"""Reports in Markdown, as files."""

import os
import tempfile

from titerloom.operators import markdown as M
from titerloom.sources.text_files import write_text_files

REPORTS = "report string, kind string, title string, lab_date string, uploaded string, tags array<string>"
ROWS = "report string, marker string, group_name string, id long, ts timestamp, value string, unit string, reference string, source string, page string, date string, current boolean, trend string"


def rows(report, own=()):
    from datetime import datetime

    day = lambda d: datetime(2024, 1, d)
    out = [
        ("Iron", "B | C", 1, day(1), "5", "mg", "1–6", "Lab", "1", "1 Jan"), ("Iron", "B | C", 2, day(3), "⬆️ 7", "mg", "1–6", "Lab", None, "3 Jan"), ("Zinc", " ", 3, day(2), "a|b\nc", None, "—", None, "2", "2 Jan"),
        ("Alpha", "B | C", 4, day(3), "1", "u", "—", "X", "3", "3 Jan"), ("Alpha", "B | C", 5, None, "0", "u", "—", "X", None, None),
    ]
    return [(report, *r, r[2] in own, "▁▂" if r[0] == "Iron" else None) for r in out]


def test_files(spark):
    reports = spark.createDataFrame([("r1", "markers", "Chosen", None, None, None), ("r2", "file", "F", "2 Jan", "3 Jan", ["a", "b"]), ("r3", "file-history", "H", None, "3 Jan", []), ("r4", "markers", "One", None, None, None), ("r5", "markers", "None", None, None, None)], REPORTS)
    table = spark.createDataFrame(rows("r1") + rows("r2", (1, 3)) + rows("r3", (2, 3)) + rows("r4")[:2], ROWS)
    folder = tempfile.mkdtemp(prefix="spark-") + "/out"
    write_text_files(M.lines(reports, table).withColumnRenamed("report", "name"), "file://" + folder)
    got = {f: open(f"{folder}/{f}", encoding="utf-8").read() for f in sorted(os.listdir(folder))}
    head = "| Marker | Value | Unit | Reference | Date | {}Trend |\n| --- | --- | --- | --- | --- | {}--- |\n"
    history = "| Date | Value | Unit | Reference | Source | Page |{}\n| --- | --- | --- | --- | --- | --- |{}\n"
    iron = ["| 3 Jan | ⬆️ 7 | mg | 1–6 | Lab | — |", "| 1 Jan | 5 | mg | 1–6 | Lab | 1 |"]
    alpha = ["| 3 Jan | 1 | u | — | X | 3 |", "| — | 0 | u | — | X | — |"]
    zinc = ["| 2 Jan | a\\|b c | — | — | — | 2 |"]
    assert list(got) == ["r1.md", "r2.md", "r3.md", "r4.md", "r5.md"]
    assert got["r4.md"] == "# One\n\n" + history.format("", "") + "\n".join(iron) + "\n"
    assert got["r5.md"] == "# None\n\n" + head.format("", "")
    plain = lambda name, body: f"\n### {name}\n\n" + history.format("", "") + "\n".join(body) + "\n"
    assert got["r1.md"] == (
        "# Chosen\n\n" + head.format("", "") + "| **B \\| C** |  |  |  |  |  |\n| Alpha | 1 | u | — | 3 Jan | — |\n| Iron | ⬆️ 7 | mg | 1–6 | 3 Jan | ▁▂ |\n| **Ungrouped** |  |  |  |  |  |\n| Zinc | a\\|b c | — | — | 2 Jan | — |\n"
        + plain("Alpha", alpha) + plain("Iron", iron) + plain("Zinc", zinc)
    )
    assert got["r2.md"] == (
        "# F\n\n- Lab date: 2 Jan\n- Uploaded: 3 Jan\n- Tags: a, b\n\n" + head.format("Page | ", "--- | ") + "| **B \\| C** |  |  |  |  |  |  |\n| Iron | 5 | mg | 1–6 | 1 Jan | 1 | ▁▂ |\n| **Ungrouped** |  |  |  |  |  |  |\n| Zinc | a\\|b c | — | — | 2 Jan | 2 | — |\n"
    )
    marked = lambda name, body: f"\n### {name}\n\n" + history.format(" Current file |", " --- |") + "\n".join(body) + "\n"
    assert got["r3.md"].endswith(marked("Alpha", [x + "  |" for x in alpha]) + marked("Iron", [iron[0] + " Yes |", iron[1] + "  |"]) + marked("Zinc", [zinc[0] + " Yes |"]))
