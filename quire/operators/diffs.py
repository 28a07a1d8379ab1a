"""Line and word differences, by the standard matcher in Arrow batches."""

import difflib

import pandas as pd

from quire.functions.arrow import arrow_udf


def word_diff(a: str | None, b: str | None) -> str:
    """Words of a and b: removed ones as [-x-], added ones as {+y+}."""
    x, y = (a or "").split(), (b or "").split()
    out: list[str] = []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if tag == "equal":
            out += x[i:j]
        if tag in ("delete", "replace"):
            out.append("[-" + " ".join(x[i:j]) + "-]")
        if tag in ("insert", "replace"):
            out.append("{+" + " ".join(y[k:m]) + "+}")
    return " ".join(out)


def line_diff(a: str | None, b: str | None, context: int = 1) -> list[dict]:
    """Rows (op, left_line, right_line, text) of changed lines and ``context`` lines around them."""
    x, y = (a or "").split("\n"), (b or "").split("\n")
    rows = []
    for group in difflib.SequenceMatcher(None, x, y, autojunk=False).get_grouped_opcodes(context):
        for tag, i, j, k, m in group:
            if tag == "equal":
                rows += [{"op": "=", "left_line": i + n, "right_line": k + n, "text": x[i + n]} for n in range(j - i)]
            if tag in ("delete", "replace"):
                rows += [{"op": "-", "left_line": n, "right_line": None, "text": x[n]} for n in range(i, j)]
            if tag in ("insert", "replace"):
                rows += [{"op": "+", "left_line": None, "right_line": n, "text": y[n]} for n in range(k, m)]
    return rows


@arrow_udf("string")
def words_changed(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([word_diff(x, y) for x, y in zip(a, b)])


@arrow_udf("array<struct<op:string,left_line:int,right_line:int,text:string>>")
def lines_changed(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([line_diff(x, y) for x, y in zip(a, b)])
