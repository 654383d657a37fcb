import math
import pytest

from stranda.llm import pii

NAMES = [("Tibor", "given"), ("Zoë", "given"), ("May", "given"), ("Rose", "given"), ("Quill", "family"), ("Marchétti", "family"), ("Oak-Tor", "family"), (None, "given")]
KNOWN = pii.Names([n for n in NAMES if n[0]])


def found(text, kind):
    body = "\n" + text
    return [body[a:b] for a, b, k in pii.spans(body, KNOWN) if k == kind]


CASES = {
    "email": [
        ("write to <a.b+c@mail.x-y.example>, please", ["a.b+c@mail.x-y.example"]), ("mailto:j_d@x.test.", ["j_d@x.test"]), ("be mailed at j-d at x dot test. We", ["j-d at x dot test"]),
        ("a (at) x (dot) y (dot) test", ["a (at) x (dot) y (dot) test"]), ("a[at]x[dot]test", ["a[at]x[dot]test"]), ("a [at] x-y.test", ["a [at] x-y.test"]), ("A AT X DOT TEST", ["A AT X DOT TEST"]),
        ("mailed at x.y soon, @home look, svc@node17:~$, a@b", []), ("a@x.te=\nst", []), ("ä a@x.test", ["a@x.test"]),
    ],
    "person": [
        ("Dear Tibor Quill,", ["Tibor Quill"]), ("ZOË K. MARCHÉTTI (x)", ["ZOË K. MARCHÉTTI"]), ("rose b oak-tor", ["rose b oak-tor"]), ("Quill, Tibor", ["Quill, Tibor"]), ("Tibor  Quill", ["Tibor  Quill"]),
        ("to Tibor Quill, Rose Oak-Tor", ["Tibor Quill", "Rose Oak-Tor"]), ("tibor.quill@x.test tibor-quill Tibor\nQuill", []), ("May it be. Quill protocol, Tibor left", []), ("Tiborx Quill; xTibor Quill; Tibor Quills", []), ("İ Tibor Quill", ["Tibor Quill"]),
    ],
    "phone": [
        ("T: +1.758.555.0123, x", ["+1.758.555.0123"]), ("(423)555-0123", ["(423)555-0123"]), ("call +1 (551) 555 0102.", ["+1 (551) 555 0102"]), ("1-396-555-0157 or 324-555-0180", ["1-396-555-0157", "324-555-0180"]),
        ("+44 (0)1632 960098 0044 1632 960299 +44-1632-960-404", ["+44 (0)1632 960098", "0044 1632 960299", "+44-1632-960-404"]), ("Plate 0042-719-9920, 2065550380, version 936.706.861, 192.0.2.104, 20:61221808-54321930", []),
        ("12-345-678-9012 345-678-90123 345-678-9012-3", []), ("345-678\n-9012", []),
    ],
    "id_number": [("949-48-5643 and 985 57 2846", ["949-48-5643", "985 57 2846"]), ("ZX583945C ZX 50 79 62 B QQ 764117 B ZX-45-89-40-B", ["ZX583945C", "ZX 50 79 62 B", "QQ 764117 B", "ZX-45-89-40-B"]), ("Order 9124-41-2600 206555058 QQ827887 ZX583945E zx583945c AZX583945C", [])],
    "address": [
        ("to 4312b Marigold Court and", ["4312b Marigold Court"]), ("172 OLD TANNERY SQUARE, second floor", ["172 OLD TANNERY SQUARE"]), ("12 Cooper Hill Rd.", ["12 Cooper Hill Rd"]), ("nach Mühlenweg 2987a, Hinterhaus", ["Mühlenweg 2987a"]),
        ("the 3 Lane layout, 935-40-2280 to close the, 50 of them Way", []), ("Kiefernstraße\n12", []),
    ],
}


@pytest.mark.parametrize("kind,text,want", [(k, t, w) for k, v in CASES.items() for t, w in v])
def test_shapes(kind, text, want):
    assert found(text, kind) == want


def test_own_ids_are_no_addresses():
    text = "Message-ID: <1@x.test>\nReferences: <2@x.test>\n\t<3@x.test>\nFrom: a@x.test\nin-reply-to: <4@x.test>\n\nMessage-ID: <5@x.test>\n"
    assert [text[a:b] for a, b, k in pii.spans(text, KNOWN)] == ["a@x.test", "5@x.test"]


def test_redaction_keeps_the_rest():
    text = "\nDear Tibor Quill, call 324-555-0180 or a@x.test.\nBye"
    assert pii.redact(text, pii.spans(text, KNOWN)) == "\nDear [PERSON], call [PHONE] or [EMAIL].\nBye"
    assert pii.redact("plain", []) == "plain"


def test_frames(spark):
    names = spark.createDataFrame(NAMES, "name_text string, name_role string")
    docs = spark.createDataFrame([(1, "\nTibor Quill, Tibor Quill", "p"), (2, None, "p"), (3, "", "p"), (4, "x" * 300000 + " a@x.test", "p")], "doc_id long, text string, pii_kind string")
    assert {tuple(r) for r in pii.find(docs, names).collect()} == {(1, "person", "Tibor Quill"), (4, "email", "a@x.test")}
    out = {r.doc_id: (r.text, r.n_replaced) for r in pii.redacted(docs, names).collect()}
    assert out[1] == ("\n[PERSON], [PERSON]", 2) and out[2] == (None, 0) and out[3] == ("", 0) and out[4][0].endswith(" [EMAIL]")
    assert pii.find(docs.where("false"), names).count() == 0 and pii.find(docs, names.where("false")).where("pii_kind = 'person'").count() == 0


def test_disclosing_terms(spark):
    names = spark.createDataFrame(NAMES, "name_text string, name_role string")
    rows = [(i, f"h: x\n\nTibor Quill keeps the heronry report\nRose Quill wrote the report {i}") for i in range(6)] + [(10 + i, "h: x\n\nMay Oak-Tor the report") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.term: r for r in pii.disclosing_terms(docs, names, bits=1.0).collect()}
    assert set(got) == {"keeps", "heronry", "wrote"} and got["heronry"].entity == "quill tibor" and got["heronry"].n_both == 6


def test_sanitised(spark):
    names = spark.createDataFrame(NAMES, "name_text string, name_role string")
    rows = [(i, f"h: x\n\nTibor Quill keeps the Heronry 4711 report\nRose Quill wrote the report {i}") for i in range(6)] + [(10 + i, "h: x\n\nMay Oak-Tor the report") for i in range(6)] + [(20, None), (21, "h: x\n\nheronry")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitised(docs, names, bits=1.0).collect()}
    assert got[3] == "h: x\n\n[PERSON] [TERM] the [TERM] [NUMBER] report\n[PERSON] [TERM] the report 3"
    assert got[10] == "h: x\n\n[PERSON] the report" and got[20] is None and got[21] == "h: x\n\nheronry" and len(got) == 14


def test_many_disclosing_terms_come_by_joins(spark, monkeypatch):
    """Beyond the number that travels with the tasks the texts are the same."""
    names = spark.createDataFrame(NAMES, "name_text string, name_role string")
    rows = [(i, f"h: x\n\nTibor Quill keeps the Heronry 4711 report\nRose Quill wrote the report {i}") for i in range(6)] + [(10 + i, "h: x\n\nMay Oak-Tor the report") for i in range(6)] + [(20, None), (21, "h: x\n\nheronry")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda: {r.doc_id: r.text for r in pii.sanitised(docs, names, bits=1.0).collect()}
    few = got()
    monkeypatch.setattr(pii, "FEW_TERMS", 0)
    assert got() == few and "[TERM]" in few[3]


def test_all_lines_and_kinds_count(spark):
    """Lines without an entity make a term common, header lines and entities of all kinds are looked at."""
    names = spark.createDataFrame(NAMES, "name_text string, name_role string")
    rows = [(i, f"Subject: falcon project a@x.test\n\nTibor Quill keeps the weather report\nring 324-555-0180 about gasket {i}") for i in range(6)]
    rows += [(100 + i, "Subject: other\n\nthe weather is fine") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.term, r.kind, r.entity): r for r in pii.disclosing_terms(docs, names, bits=1.0).collect()}
    assert {("falcon", "email", "a@x.test"), ("gasket", "phone", "3245550180"), ("keeps", "person", "quill tibor")} <= set(got)
    assert not {t for t, _, _ in got} & {"weather", "the", "subject"}
    keeps = got["keeps", "person", "quill tibor"]
    assert (keeps.n_both, keeps.n_term, keeps.n_entity, keeps.pmi_bits) == (6, 6, 6, round(math.log2((6 * 3 + 60 * 2) / 6), 6))
    text = {r.doc_id: r.text for r in pii.sanitised(docs, names, bits=1.0).collect()}
    assert text[3] == "Subject: [TERM] [TERM] [EMAIL]\n\n[PERSON] [TERM] the weather [TERM]\n[TERM] [PHONE] [TERM] [TERM] 3"
    assert text[101] == rows[7][1]


def test_forms_decide_what_is_found(spark):
    """A shape that stands inside longer numbers nearly everywhere tells little about telephone numbers, and its strings
    are not taken for any; the same string in a corpus without the longer numbers is found."""
    names = spark.createDataFrame(NAMES, "name_text string, name_role string")
    decoys = [(i, f"h: x\n\nlot 345-678-9{i:03d}-7 and 12 more of it") for i in range(60)]
    told = [(100, "h: x\n\nring 324-555-0180 today or (423)555-0123"), (101, "h: x\n\nTibor Quill met Rose Quill at the Quill bridge")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda rows, **kw: {tuple(r) for r in pii.find(frame(rows), names, **kw).collect()}
    persons = {(101, "person", "Tibor Quill"), (101, "person", "Rose Quill")}
    other, plain = (100, "phone", "(423)555-0123"), (100, "phone", "324-555-0180")
    assert got(told) == persons | {other, plain}
    assert got(decoys + told, bits=4.0) == persons | {other} and got(decoys + told, bits=-9.0) == persons | {other, plain}
    forms = {(r.kind, r.form): r for r in pii.disclosing_forms(frame(decoys + told), names, bits=-9.0).collect()}
    f = forms["phone", "9-9-9"]
    words = sum(t.count(" ") + t.count("\n") + 1 for _, t in decoys + told)
    assert (f.n, f.n_whole, f.n_kind, f.n_words, f.pmi_bits) == (61, 1, 2, words, round(math.log2(words / (61 * 2)), 6))
    q = forms["person", "quill"]
    assert (q.n, q.n_whole) == (3, 2)
    out = {r.doc_id: r.text for r in pii.redacted(frame(decoys + told), names, bits=4.0).collect()}
    assert out[100] == "h: x\n\nring 324-555-0180 today or [PHONE]" and out[3] == decoys[3][1]
    assert pii.disclosing_forms(frame([]), names).count() == 0


def test_entities_cut_by_a_soft_line_break():
    text = "\nto 12 Cooper St=\nreet or 12 Cooper Hill Rd=\n, Tibor Quill=\nham, +44 1632 96009=\r\n8"
    assert [text[a:b] for a, b, _ in pii.spans(text, KNOWN)] == ["12 Cooper Hill Rd"]
