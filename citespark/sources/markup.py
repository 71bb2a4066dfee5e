"""The text of a law's unit from its XML: which elements are blocks, headings, markers and furniture is a matter of their names."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame

#: Names of elements.
HEADING, BLOCKS, MARKERS, FURNITURE = "ueberschrift", {"absatz", "listelem", "schlussteil"}, {"symbol", "gldsym"}, {"kzinhalt", "fzinhalt", "layoutdaten"}


def name(el) -> str:
    return el.tag.rsplit("}", 1)[-1]


def own_text(el) -> str:
    """The text of a block without that of blocks inside it; list markers end with a blank."""
    said: list[str] = []
    todo = [(el, 0, el.text or "")]
    while todo:
        node, at, text = todo.pop()
        said.append(text)
        if at < len(node):
            child = node[at]
            todo.append((node, at + 1, child.tail or ""))
            if name(child) in MARKERS:
                said.append("".join(child.itertext()) + " ")
            elif name(child) not in BLOCKS | {HEADING}:
                todo.append((child, 0, child.text or ""))
            # a node's next child comes after what its present child holds, so its tail waits below on the stack
    return " ".join("".join(said).split())


def unit_items(xml: str) -> list[tuple[int, str, str | None, str]]:
    """(pos, kind, typ, text) of the blocks, headings and furniture of one unit, in order, as chunking.body_state reads them."""
    out: list[tuple[int, str, str | None, str]] = []

    def walk(node) -> None:
        for el in node:
            kind = name(el)
            if kind in FURNITURE:
                out.append((len(out), "furniture", None, ""))
            elif kind == HEADING:
                out.append((len(out), "heading", el.get("typ"), own_text(el)))
            else:
                if kind in BLOCKS:
                    out.append((len(out), "block", None, own_text(el)))
                walk(el)

    walk(ElementTree.fromstring(xml))
    return out


def items(units: DataFrame) -> DataFrame:
    """(unit, xml) -> (unit, pos, kind, typ, text). Payloads that are not XML are an error: they are answers of another kind."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for unit, xml in zip(pdf["unit"], pdf["xml"]):
                if not (xml or "").startswith("<?xml"):
                    raise ValueError(f"unit {unit} is not XML")
                rows += [(unit, *item) for item in unit_items(xml)]
            yield pd.DataFrame(rows, columns=["unit", "pos", "kind", "typ", "text"])

    return units.select("unit", "xml").mapInPandas(run, "unit long, pos int, kind string, typ string, text string")
