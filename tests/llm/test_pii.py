import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm import pii
from pointloom.llm.queries import op10_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(len(x.lstrip("0")) > 3 or int(x[-3:]) > 255 for x in m[0].split(".")):
                continue
            if k == "card" and not (12 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if k == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(PATTERNS).index(k), m.end()))
    return sorted(out)


def base(text):
    return [x for x in pii.find_spans(text) if x[1] < 4]


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("ab.@@+1200 -()9é:/"), max_size=60))
def test_base_equals_patterns(text):
    assert base(text) == plain(text)


def test_known():
    for text in ("x@a.com@b.com", "a@b@c.co.uk.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "4111 1111-1111 1111", "4111111111111112", "+1 (017) 555-7713 x", "+1+1234567890", "é@a.b", "1" * 5000 + ".1.1.1", "@a.b c@d", "a@b.c@d.e"):
        assert base(text) == plain(text), text
    kinds = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.find_spans(t)]
    assert kinds('see https://u:p@x.example.com/a?b, token = "92A3"; TOKEN = "A233A8ECF7C5B09F"!!') == [("url", "https://u:p@x.example.com/a?b"), ("email", "p@x.example.com"), ("account", "A233A8ECF7C5B09F")]
    assert not kinds("the account of a token is here; password: none")
    assert pii.redacted("to a@b.cd or 1.2.3.4!") == "to <EMAIL> or <IP>!"
    assert pii.redacted(None) is None and pii.redacted("") == ""


def test_query(spark, tmp_path):
    texts = [None, "", "a@b.cd 1.2.3.4", "x " * 50_000 + "+1 (614) 555-8001", "a@b.cd 1.2.3.4"]
    spark.createDataFrame([(i % 4, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op10_pii(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in enumerate(texts):
        said = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        spans = plain(t)
        want.append((i % 4, *(sum(k == n for _, k, _ in spans) for n in range(4)), hashlib.sha256(said(spans).encode()).hexdigest(), said(pii.find_spans(t))))
    assert got == sorted(want, key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(empty).count() == 0 and pii.redact(empty).count() == 0


def test_long_secrets_are_taken_whole():
    secret = "a1B2c3D4" * 40
    text = f"see token = '{secret}' and x"
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in pii.find_spans(text)] == [("account", secret)]
    assert pii.redacted(text) == "see token = '<ACCOUNT>' and x"
    assert not pii.find_spans("tokenis" * 100_000)


OLD = re.compile(r"(?:[\x20_-]?(?:no|nr|number|id))?\.?[\x20\t]?(?:[:=#]|is)[\x20\t]?[\"']?([A-Za-z0-9](?:[A-Za-z0-9-]|\x20(?=[0-9]{2})){4,}[A-Za-z0-9])", re.I)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["token", "is", "no", "id", ":", "=", " ", "-", "'", ".", "1", "23", "4567", "a", "iban"]), max_size=25).map("".join))
def test_values_equal_their_pattern(text):
    want, end = [], 0
    for c in re.finditer("token|iban", text):
        if c.end() > end and (m := OLD.match(text, c.end())) and sum(map(str.isdigit, m[1])) >= 4:
            want.append((m.start(1), m.end(1)))
            end = m.end(1)
    assert [(s, e) for s, k, e in pii.find_spans(text) if k == 5] == want
