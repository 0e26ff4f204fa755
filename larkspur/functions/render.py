"""Rows of printed tables as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What LaTeX reads as commands, and how each is printed.
LATEX = {
    "\\": "\\textbackslash{}",
    "&": "\\&",
    "%": "\\%",
    "$": "\\$",
    "#": "\\#",
    "_": "\\_",
    "{": "\\{",
    "}": "\\}",
    "~": "\\textasciitilde{}",
    "^": "\\textasciicircum{}",
}


def latex_text(text: Column) -> Column:
    """Text with each character that LaTeX reads as a command escaped, once."""
    escaped = lambda c: reduce(lambda so_far, k: so_far.when(c == k, LATEX[k]), list(LATEX)[1:], F.when(c == "\\", LATEX["\\"])).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), escaped), "")


def fixed(value: Column, digits: int = 3) -> Column:
    """A number with so many digits after the point; nulls as a dash."""
    return F.coalesce(F.format_string(f"%.{digits}f", F.round(value.cast("double"), digits)), F.lit("-"))


def latex_row(*cells: Column) -> Column:
    return F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\"))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def latex_table(body: list[str], header: list[str], caption: str, label: str) -> str:
    """A whole table from rows that ``latex_row`` made; meant for the few rows of a report."""
    heads = " & ".join(header) + " \\\\"
    return "\n".join(["\\begin{table}[htbp]", "\\centering", f"\\caption{{{caption}}}", f"\\label{{{label}}}", f"\\begin{{tabular}}{{l{'r' * (len(header) - 1)}}}", "\\toprule", heads, "\\midrule", *body, "\\bottomrule", "\\end{tabular}", "\\end{table}"])
