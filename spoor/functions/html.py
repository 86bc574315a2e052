"""Scripts in HTML: a table function over an HTML parser, and an expression for the plain case."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.session import ship


class _Scripts(HTMLParser):
    """(kind, text): src of script tags, text of inline scripts, values of on... attributes, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.found: list[tuple[str, str]] = []
        self.inside: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for name, value in attrs:
            if tag == "script" and name == "src":
                self.found.append(("src", value or ""))
            if name.startswith("on"):
                self.found.append(("handler", value or ""))
        if tag == "script":
            self.inside = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.inside is not None:
            if text := "".join(self.inside):
                self.found.append(("inline", text))
            self.inside = None

    def handle_data(self, data: str) -> None:
        if self.inside is not None:
            self.inside.append(data)


def scripts_in(html: str | None) -> list[tuple[str, str]]:
    parser = _Scripts()
    parser.feed(html or "")
    parser.close()
    if parser.inside is not None and (text := "".join(parser.inside) + parser.rawdata):  # the text ended inside a script
        parser.found.append(("inline", text))
    return parser.found


def tokenize(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """keys, kind (src, inline or handler), text: a row per script of each page."""
    ship(pages.sparkSession)
    schema = pages.select(*keys).schema.add("kind", "string").add("text", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*k, kind, text) for *k, h in b[[*keys, html]].itertuples(index=False) for kind, text in scripts_in(h)]
            yield pd.DataFrame(rows, columns=[*keys, "kind", "text"])

    return pages.select(*keys, html).mapInPandas(run, schema)


def inline_scripts(html: Column) -> Column:
    """Texts of inline scripts, inside the JVM: for pages whose script tags are lower case and well formed."""
    return F.regexp_extract_all(html, F.lit(r"(?s)<script[^>]*>(.*?)</script"), F.lit(1))
