"""The comparison of two phases as a picture: bars to both sides of zero, as SVG text."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

FASTER, SLOWER = "#1b7f5c", "#b5482f"
WIDTH, LABELS, ROW, TOP, ROOM = 760, 220, 30, 48, 56


def diverging_bars(values: list[tuple[str, float]], title: str, axis: str) -> str:
    """One bar per (label, percent), from the first at the top. Positive ones go right; both ends leave room for the numbers."""
    low, high = min([0.0, *(v for _, v in values)]), max([0.0, *(v for _, v in values)])
    scale = (WIDTH - LABELS - 2 * ROOM) / ((high - low) or 1.0)
    at = lambda v: LABELS + ROOM + (v - low) * scale
    bottom = TOP + ROW * len(values)
    text = lambda x, y, said, anchor="start": f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}">{escape(said)}</text>'
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{bottom + 40}" font-family="sans-serif" font-size="12">', text(8, 22, title)]
    for k, (label, value) in enumerate(values):
        y = TOP + ROW * k
        out.append(text(LABELS - 8, y + 19, label, "end"))
        out.append(f'<rect x="{min(at(0), at(value)):.1f}" y="{y + 6}" width="{abs(value) * scale:.1f}" height="{ROW - 12}" fill="{FASTER if value >= 0 else SLOWER}"/>')
        out.append(text(at(value) + (6 if value >= 0 else -6), y + 19, f"{value:+.0f}%", "start" if value >= 0 else "end"))
    out.append(f'<line x1="{at(0):.1f}" x2="{at(0):.1f}" y1="{TOP}" y2="{bottom}" stroke="#666"/>')
    out += [text(WIDTH / 2, bottom + 26, axis, "middle"), "</svg>"]
    return "\n".join(out)


def save_chart(compared: DataFrame, path: str | Path, names: Mapping[int, str] | None = None, title: str = "Execution time before and after") -> int:
    """Writes the chart of measure.compared() to a file of the driver and returns the number of bars. Scenarios that lack a phase, or whose time before is not above 0, have none."""
    rows = compared.filter("exec_change is not null").select("scenario", "exec_change").orderBy("scenario").collect()
    values = [((names or {}).get(r.scenario, f"scenario {r.scenario}"), r.exec_change) for r in rows]
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(diverging_bars(values, title, "change of execution time in percent: right is faster, left is slower"), encoding="utf-8")
    return len(values)
