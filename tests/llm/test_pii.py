import hashlib
import random
import re

from fixtures import edge_docs, edge_texts, no_docs, rows, SCHEMA
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute(text: str) -> list[tuple[int, int, str]]:
    """The contract, pattern by pattern."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab1290+@.-% ()\nÉ", max_size=60))
def test_base_spans_follow_the_contract(text):
    assert pii.base_spans(text) == brute(text)


def test_base_spans_of_structured_texts():
    rng = random.Random(3)
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "999.1.2.3", "00001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (650) 555-0100", "+49 30 1234567", "+1", "word", "\n", ", ", "1.2.3.4@5.6.7", "é@é.fr"]
    for _ in range(500):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "-", "."]) for _ in range(12))
        assert pii.base_spans(text) == brute(text)


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a@" * 100_000, "1." * 100_000, "a." * 100_000 + "@", "+1" * 100_000, "1 " * 100_000):
        pii.base_spans(text)


def test_query_columns(spark):
    texts = ["mail a.b@c.de or 10.0.0.1", "call (650) 555-0100 today, or write to jane (at) example (dot) com", None, "", "card 4111 1111 1111 1111."]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows(texts), SCHEMA), redact=True).collect()}
    for i, t in enumerate(texts):
        base = brute(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s[2] == k for s in base) for k in PATTERNS]
        spans = [s for s in got[i]["spans"].split(",") if s]
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), [*PATTERNS, "secret"].index(s.split(":")[0])))
        assert got[i]["n_added"] == len(spans) - len(base)
    assert got[1]["n_added"] >= 1 and "555" not in got[1]["clean"]
    assert got[0]["clean"] == "mail [EMAIL] or [IP]" and got[4]["clean"] == "card [CARD]."
    assert got[2]["clean"] is None


def test_gradient_of_the_tagger():
    import numpy as np

    t = pii.Tagger(hidden=3, embed=2, seed=1)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x, y = pii.batch_of(np.random.default_rng(2), 2)
    x, y = x[:, :9], y[:, :9]
    _, g = t.loss_grad(x, y)
    for name in ("T", "O", "Uf", "Wb", "E"):
        at = tuple(s // 2 for s in t.p[name].shape) if name != "E" else (int(x[0, 4]), 1)
        eps, old = 1e-3, t.p[name][at]
        t.p[name][at] = old + eps
        up = t.loss_grad(x, y)[0]
        t.p[name][at] = old - eps
        down = t.loss_grad(x, y)[0]
        t.p[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-3


def test_the_tagger_finds_held_out_spans():
    import numpy as np

    tagger, rng, hit, whole, false = pii.trained(), np.random.default_rng(99), 0, 0, 0
    for _ in range(150):
        text, spans = pii.sample(rng)
        inner = [s for s in spans if s[0] > 0 and s[1] < len(text) and (s[2] != "card" or luhn(re.sub("[^0-9]", "", text[s[0] : s[1]])))]  # invented cards mostly fail Luhn
        base = pii.base_spans(text)
        got = base + pii.tag_texts(tagger, [text], [base])[0]
        whole += len(inner)
        hit += sum(any(a < y and x < b for a, b, _ in got) for x, y, _ in inner)
        false += sum(not any(a < y and x < b for x, y, _ in spans) for a, b, _ in got)
    assert hit >= 0.9 * whole and false <= 0.1 * whole


def test_spans_over_window_edges_are_whole():
    tagger = pii.trained()
    for at in range(0, 100, 7):
        text = "z" * at + " token = " + '"ghp_' + "a1B2" * 9 + '" done'
        (span,) = pii.tag_texts(tagger, [text], [pii.base_spans(text)])[0]
        assert span[1] - span[0] >= 36 and span[2] == "secret"


def test_edges(spark):
    got = pii.find_pii(edge_docs(spark)).collect()
    assert len(got) == len(edge_texts()) + 2
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty and r["spans"] == "" for r in got if r["doc_id"] in (0, 1, 2))
    assert pii.find_pii(no_docs(spark)).count() == 0
