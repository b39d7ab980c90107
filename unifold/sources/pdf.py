"""PDF hook: text and link annotations by an injected extractor.

No PDF library is required. ``default_extractor`` tries the usual ones if they are installed,
one after the other, each starting afresh; the first that finds text wins.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "path string, text string, uris array<string>"


def classify_uris(uris):
    """Annotation addresses to links and e-mails, as a pair of columns; the last of each kind counts.

    The order of the tests: mail, professional network, code host, portfolio, others (distinct).
    """
    u = F.filter(F.transform(F.coalesce(uris, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    mail = lambda x: F.startswith(F.lower(x), F.lit("mailto:"))
    net = lambda x: ~mail(x) & F.contains(x, F.lit("linkedin.com/in/"))
    host = lambda x: ~mail(x) & ~net(x) & F.contains(x, F.lit("github.com/"))
    page = lambda x: ~mail(x) & ~net(x) & ~host(x) & (F.contains(x, F.lit("github.io")) | F.contains(x, F.lit("portfolio")))
    rest = lambda x: ~mail(x) & ~net(x) & ~host(x) & ~page(x)
    last = lambda f: F.coalesce(F.get(F.reverse(F.filter(u, f)), F.lit(0)), F.lit(""))
    links = F.struct(last(net).alias("linkedin"), last(host).alias("github"), last(page).alias("portfolio"), F.array_distinct(F.filter(u, rest)).alias("other"))
    emails = F.array_distinct(F.filter(F.transform(F.filter(u, mail), lambda x: F.trim(F.substring(x, F.lit(8), F.length(x)))), lambda x: x != ""))
    return links, emails


def pdf_rows(files: DataFrame, extractor: Callable[[bytes], tuple[str, list[str]]]) -> DataFrame:
    """(path, text, pdf_links, pdf_emails) of PDF files; a file the extractor fails on has no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    text, uris = extractor(bytes(content))
                except Exception:  # one bad file must not end the job
                    text, uris = "", []
                rows.append((path, text, list(uris)))
            yield pd.DataFrame(rows, columns=["path", "text", "uris"])

    links, emails = classify_uris(F.col("uris"))
    return files.select("path", "content").mapInPandas(run, _SCHEMA).select("path", "text", links.alias("pdf_links"), emails.alias("pdf_emails"))


def default_extractor(content: bytes) -> tuple[str, list[str]]:
    """Text and annotation addresses by whichever PDF library is installed."""
    uris: list[str] = []
    text = ""
    try:
        import pypdf

        reader = pypdf.PdfReader(io.BytesIO(content))
        text = "".join(f"{page.extract_text() or ''}\n" for page in reader.pages)
        for page in reader.pages:
            for a in page.annotations or []:
                obj = a.get_object()
                if obj.get("/Subtype") == "/Link" and (uri := obj.get("/A", {}).get("/URI")):
                    uris.append(str(uri))
    except Exception:
        text = text if text.strip() else ""
    if not text.strip():
        try:
            import pdfplumber

            with pdfplumber.open(io.BytesIO(content)) as pdf:
                text = "".join(f"{page.extract_text() or ''}\n" for page in pdf.pages)
        except Exception:
            text = ""
    if not text.strip():
        try:
            import pytesseract
            from pdf2image import convert_from_bytes

            text = "".join(f"{pytesseract.image_to_string(image)}\n" for image in convert_from_bytes(content))
        except Exception:
            text = ""
    return text, uris
