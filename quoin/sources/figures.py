"""Small SVG figures of collected numbers: lines, bars and heat maps. What they show is aggregated before, in Spark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html import escape


def _clean(values: Sequence[float | None]) -> list[float | None]:
    return [None if v is None or v != v else float(v) for v in values]


def _frame(title: str, body: list[str], width: int, height: int) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="20" y="20">{escape(title)}</text>{"".join(body)}</svg>'


def lines(series: Mapping[str, Sequence[float | None]], title: str, width: int = 640, height: int = 240) -> str:
    """One line a series over its positions; missing values leave a gap in the points, not in the scale."""
    own = {n: _clean(s) for n, s in series.items()}
    values = [v for s in own.values() for v in s if v is not None]
    low, high = (min(values), max(values)) if values else (0.0, 1.0)
    span = (high - low) or 1.0
    body = []
    for i, (name, s) in enumerate(own.items()):
        step = (width - 40) / max(1, len(s) - 1)
        points = " ".join(f"{20 + k * step:.1f},{height - 20 - (v - low) / span * (height - 50):.1f}" for k, v in enumerate(s) if v is not None)
        body.append(f'<polyline fill="none" stroke="hsl({i * 67 % 360},60%,45%)" points="{points}"><title>{escape(name)}</title></polyline>')
    return _frame(title, body, width, height)


def bars(values: Mapping[str, float | None], title: str, width: int = 640, height: int = 240) -> str:
    """One bar a name, up or down from zero; missing values have none."""
    own = dict(zip(values, _clean(list(values.values()))))
    most = max((abs(v) for v in own.values() if v is not None), default=1.0) or 1.0
    step, zero = (width - 40) / max(1, len(own)), (height + 20) / 2
    body = []
    for i, (name, v) in enumerate(own.items()):
        if v is not None:
            size = abs(v) / most * (height - 60) / 2
            body.append(f'<rect x="{20 + i * step:.1f}" y="{zero - size if v > 0 else zero:.1f}" width="{step * 0.8:.1f}" height="{size:.1f}" fill="hsl({210 if v > 0 else 10},60%,45%)"><title>{escape(name)}: {v:.6g}</title></rect>')
    return _frame(title, body, width, height)


def heat_map(columns: Sequence[str], rows: Mapping[str, Sequence[float | None]], title: str, width: int = 640, cell: int = 18) -> str:
    """One cell a row and column, darker where the value is nearer to the greatest; missing values are left white."""
    own = {n: _clean(v) for n, v in rows.items()}
    values = [v for r in own.values() for v in r if v is not None]
    low, high = (min(values), max(values)) if values else (0.0, 1.0)
    span, step = (high - low) or 1.0, (width - 40) / max(1, len(columns))
    body = []
    for i, (name, r) in enumerate(own.items()):
        for k, (column, v) in enumerate(zip(columns, r)):
            if v is not None:
                body.append(f'<rect x="{20 + k * step:.1f}" y="{30 + i * cell}" width="{step:.1f}" height="{cell}" fill="hsl(210,60%,{95 - 55 * (v - low) / span:.0f}%)"><title>{escape(name)} {escape(column)}: {v:.6g}</title></rect>')
    return _frame(title, body, width, 40 + cell * len(own))
