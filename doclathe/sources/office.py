"""Word files from their XML parts; PDF through an optional library."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Core properties by their XML names.
PROPERTIES = {"creator": "author", "category": "category", "description": "comments", "created": "created", "identifier": "identifier", "keywords": "keywords", "language": "language", "modified": "modified", "subject": "subject", "title": "title", "version": "version"}
PARTS = {f"{W}t": None, f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}


def _text(p: ElementTree.Element) -> str:
    return "".join((x.text or "") if PARTS[x.tag] is None else PARTS[x.tag] for x in p.iter() if x.tag in PARTS)


def _paragraphs(root: ElementTree.Element) -> list[str]:
    return [t for p in root.findall(f"{W}p") if (t := _text(p).strip())]


def parse_docx(data: bytes, headers: bool = False, with_tables: bool = True, with_metadata: bool = True) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        paragraphs = _paragraphs(body)
        text = "\n".join(paragraphs)
        tables = [rows for t in body.findall(f"{W}tbl") if (rows := [["\n".join(_text(p) for p in c.findall(f"{W}p")).strip() for c in r.findall(f"{W}tc")] for r in t.findall(f"{W}tr")])] if with_tables else []
        if headers:
            for kind, sign in (("header", "页眉"), ("footer", "页脚")):
                for name in sorted(n for n in z.namelist() if n.startswith(f"word/{kind}")):
                    own = "\n".join(t for p in ElementTree.fromstring(z.read(name)).iter(f"{W}p") if (t := _text(p)).strip())
                    if own and kind == "header":
                        paragraphs.insert(0, f"[{sign}] {own}")
                        text = f"[{sign}] {own}\n{text}"
                    elif own:
                        paragraphs.append(f"[{sign}] {own}")
                        text += f"\n[{sign}] {own}"
        about = {}
        if with_metadata and "docProps/core.xml" in z.namelist():
            for x in ElementTree.fromstring(z.read("docProps/core.xml")):
                if (name := PROPERTIES.get(x.tag.rpartition("}")[2])) and x.text:
                    about[name] = x.text
    about |= {"paragraphs_count": str(len(paragraphs)), "tables_count": str(len(tables))}
    return {"text": text, "paragraphs": paragraphs, "tables": tables, "images": [], "metadata": about}


def pdf_pages(data: bytes, password: str | None = None, pages: tuple[int, int] | None = None) -> tuple[list[str], dict[str, str]]:
    """Texts of the pages from ``pages[0]`` up to but not ``pages[1]``, and the file's properties."""
    try:
        from pypdf import PdfReader
    except ImportError:
        raise RuntimeError("PDF needs the library pypdf, which isn't installed") from None
    reader = PdfReader(io.BytesIO(data))
    if reader.is_encrypted and not reader.decrypt(password or ""):
        raise PermissionError("wrong or missing password")
    a, b = pages or (0, len(reader.pages))
    texts = [(reader.pages[i].extract_text() or "").strip() for i in range(max(0, a), min(b, len(reader.pages)))]
    return texts, {k.strip("/"): str(v) for k, v in (reader.metadata or {}).items()} | {"total_pages": str(len(reader.pages))}


def parse_pdf(data: bytes, password: str | None = None, pages: tuple[int, int] | None = None) -> dict:
    texts, about = pdf_pages(data, password, pages)
    kept = [t for t in texts if t]
    return {"text": "\n\n".join(kept), "paragraphs": kept, "tables": [], "images": [], "metadata": about}
