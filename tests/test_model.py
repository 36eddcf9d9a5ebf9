"""The native extractors against a plain model on random texts."""

import random
import re

import pytest

from pathloom.operators.extract import extract

WS = "[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
ATTR = re.compile(f"(src|href|data|action|poster|background|cite|formaction|icon|manifest|srcset){WS}*={WS}*[\"']([^\"']+)[\"']", re.I | re.A)
URL = re.compile(f"url{WS}*\\({WS}*['\"]?([^'\"()]+?)['\"]?{WS}*\\)", re.I | re.A)


def units(s):
    return len(s.encode("utf-16-le", "surrogatepass")) // 2


def model_html(text):
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        for m in ATTR.finditer(line):
            name, value = m[1].lower(), m[2]
            at = units(line[: m.start()]) + 1
            if name == "srcset":
                for part in value.split(","):
                    part = re.sub(f"^{WS}+|{WS}+$", "", part)
                    first = re.split(f"{WS}+", part)[0]
                    if first and not first.startswith("data:"):
                        out.append((first, n, at))
            elif not value.startswith(("data:", "javascript:")):
                out.append((value, n, at))
    return out


def model_css(text):
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        if not re.search(r"@import\b", line, re.A):
            for m in URL.finditer(line):
                value = re.sub(f"^{WS}+|{WS}+\\Z", "", m[1])
                if value and not value.startswith("data:"):
                    out.append((value, n, units(line[: m.start()]) + 1))
    return out


PIECES = {
    "html": ["src", "HREF", "srcset", "=", " = ", '"', "'", "./a", "/b", "data:", "javascript:", ",", " ", "\u00a0", "\n", "\r", "é", "😀", "<", ">", "1x", "ſrc"],
    "css": ["url", "URL(", "(", ")", "'", '"', "./a", "data:x", "@import", " ", "\u3000", "\n", "😀", "x", "/*"],
}


@pytest.mark.parametrize("kind,model", [("html", model_html), ("css", model_css)])
def test_random_texts(spark, kind, model):
    draw = random.Random(11)
    texts = ["".join(draw.choice(PIECES[kind]) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    got: dict[int, list] = {}
    for r in extract(docs, kind).orderBy("doc_id", "ordinal").collect():
        if r["context"] != "CSS @import":
            got.setdefault(r["doc_id"], []).append((r["value"], r["line"], r["column"]))
    wrong = [(t, model(t), got.get(i, [])) for i, t in enumerate(texts) if model(t) != got.get(i, [])]
    assert not wrong, wrong[:2]
