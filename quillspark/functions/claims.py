"""Claims: bullets of a page's claims section, with source, confidence and date of last check."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from . import row_function, struct_of

#: Headings of the section, and labels of the fields in two languages.
HEADINGS = ("## claims", "## afirmações", "## afirmacoes")
LABELS = {
    "source": "source", "fonte": "source",
    "confidence": "confidence", "confiança": "confidence", "confianca": "confidence",
    "last verified": "last_verified", "última verificação": "last_verified", "ultima verificacao": "last_verified",
}
TYPE = T.ArrayType(struct_of(text=T.StringType(), source=T.StringType(), confidence=T.StringType(), last_verified=T.StringType()))
_FIELD = re.compile(r"(\s*)- ([^:]+):(.*)")


def _ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def blocks(content: str) -> list[tuple[int, int, dict]]:
    """(first line, line after the last, claim) of each claim."""
    lines = content.split("\n")
    begin = next((i + 1 for i, x in enumerate(lines) if _ascii_lower(x.strip()) in HEADINGS), None)
    if begin is None:
        return []
    end = next((i for i, x in enumerate(lines[begin:], begin) if x.startswith("#")), len(lines))
    starts = [i for i in range(begin, end) if lines[i].startswith("- ")]
    out = []
    for a, b in zip(starts, [*starts[1:], end], strict=True):
        claim = dict.fromkeys(("text", "source", "confidence", "last_verified"))
        claim["text"] = lines[a][2:].strip()
        for line in lines[a + 1 : b]:
            m = _FIELD.match(line.rstrip("\r"))
            if m and m[1] and (name := LABELS.get(m[2].strip().lower())):
                claim[name] = m[3].strip()
        out.append((a, b, claim))
    return out


def parse(content: str) -> list[dict]:
    return [c for _, _, c in blocks(content)]


def set_last_verified(content: str, index: int, date: str) -> str:
    """The page with the date of its claim number ``index`` (from 0) set; lines end in LF."""
    content = content.replace("\r\n", "\n")
    found = blocks(content)
    if not found:
        raise ValueError("the page has no claims section")
    if not 0 <= index < len(found):
        raise ValueError(f"no claim {index + 1}: the page has {len(found)}")
    begin, end, _ = found[index]
    lines = content.split("\n")
    bullets = [i for i in range(begin + 1, end) if lines[i].lstrip().startswith("- ")]
    for i in bullets:
        m = _FIELD.match(lines[i])
        if m and LABELS.get(m[2].strip().lower()) == "last_verified":
            lines[i] = f"{m[1]}- {m[2]}: {date}"
            break
    else:
        indent = re.match(r"\s*", lines[bullets[-1]])[0] if bullets else "  "
        lines.insert((bullets[-1] if bullets else begin) + 1, f"{indent}- Last verified: {date}")
    return "\n".join(lines)


@row_function(TYPE)
def claims(content: str | None) -> list[dict]:
    """The claims of each page, in order."""
    return parse(content or "")
