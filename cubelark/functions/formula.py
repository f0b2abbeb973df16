"""A small model-formula parser and treatment-coded designs, on the driver.

Supported: an intercept (``1``, ``0``, ``-1``), names, ``+``, ``:``, ``*`` and
parenthesis-free terms. Text columns are factors whose levels are sorted unless
given; term names are those of the usual statistical environments
(``(Intercept)``, ``grouppatient``, ``age:grouppatient``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Design:
    """Rows by subject, columns by term."""

    subjects: list[str]
    terms: list[str]
    matrix: np.ndarray
    dropped: list[str] = field(default_factory=list)

    @property
    def rank(self) -> int:
        return int(np.linalg.matrix_rank(self.matrix)) if self.matrix.size else 0


def parse(formula: str) -> tuple[bool, list[tuple[str, ...]]]:
    """(has an intercept, terms as tuples of names)."""
    text = formula.strip()
    if not text.startswith("~"):
        raise ValueError("a formula starts with ~ and has no left side")
    intercept, terms = True, []
    for sign, part in re.findall(r"([+-]?)\s*([^+-]+)", text[1:]):
        part = part.strip()
        if part in ("0", "1"):
            intercept = (part == "1") != (sign == "-")
            continue
        if sign == "-":
            raise ValueError(f"only an intercept can be taken out: {part}")
        if not re.fullmatch(r"[A-Za-z_.][\w.]*(\s*[:*]\s*[A-Za-z_.][\w.]*)*", part):
            raise ValueError(f"cannot read term {part!r}")
        names = tuple(x.strip() for x in re.split(r"[:*]", part))
        if "*" in part:
            own = [tuple(n for i, n in enumerate(names) if k >> i & 1) for k in range(1, 1 << len(names))]
            terms += sorted(own, key=len)
        else:
            terms.append(names)
    return intercept, sorted(dict.fromkeys(terms), key=len)


def design(rows: list[dict], key: str, formula: str, levels: dict[str, list] | None = None, na_action: str = "fail") -> Design:
    """Design of rows (dicts with the key); missing covariates fail with their keys, or are left out."""
    intercept, terms = parse(formula)
    names = {n for t in terms for n in t}
    missing = {n for n in names if rows and n not in rows[0]}
    if missing:
        raise ValueError(f"unknown covariates: {', '.join(sorted(missing))}")
    lost = [str(r[key]) for r in rows if any(r[n] is None or r[n] != r[n] for n in names)]
    if lost and na_action == "fail":
        raise ValueError(f"missing covariates for: {', '.join(lost)}")
    rows = [r for r in rows if str(r[key]) not in set(lost)]
    coded: dict[str, list[tuple[str, np.ndarray]]] = {}
    full = not intercept
    for n in dict.fromkeys(x for t in terms for x in t):
        values = [r[n] for r in rows]
        if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
            coded[n] = [(n, np.array(values, float))]
            continue
        text = [("TRUE" if v else "FALSE") if isinstance(v, bool) else str(v) for v in values]
        order = [str(x) for x in (levels or {}).get(n, sorted(set(text)))]
        first = 0 if full and (n,) in terms else 1
        full = full and first == 1
        coded[n] = [(f"{n}{level}", np.array([float(v == level) for v in text])) for level in order[first:]]
    labels, columns = (["(Intercept)"], [np.ones(len(rows))]) if intercept else ([], [])
    for term in terms:
        own = [("", np.ones(len(rows)))]
        for n in term:
            own = [(f"{a}:{b}" if a else b, x * y) for b, y in coded[n] for a, x in own]
        labels += [a for a, _ in own]
        columns += [x for _, x in own]
    matrix = np.stack(columns, 1) if columns else np.zeros((len(rows), 0))
    return Design([str(r[key]) for r in rows], labels, matrix, lost)


def estimable(matrix: np.ndarray, contrast: np.ndarray, tolerance: float = 1e-8) -> bool:
    """Whether a contrast lies in the row space of the design."""
    _, s, vt = np.linalg.svd(np.asarray(matrix, float), full_matrices=True)
    rank = int((s > tolerance * max(s.max(initial=0), 1e-300)).sum())
    null = vt[rank:]
    return bool(np.abs(null @ np.asarray(contrast, float)).max(initial=0) <= tolerance * max(1.0, float(np.abs(contrast).max())))
