"""Personal information in free text: found, replaced by typed placeholders, and terms that give a person away.

Terms are the forms in which something stands in text: the shape of an address's local part and the place it stands in,
the mask of a number, a street word with the shape of what is before it, a family name. Over the whole corpus each form is
counted wherever it occurs, and where it occurs as a whole entity of a kind: not inside a longer number, not a mail's own
id, with a given name. A form whose co-occurrence with a kind tells at least a threshold of bits about it (pointwise
mutual information, words being the trials) discloses the kind; the strings of disclosing forms are what is found and
replaced. Which other terms reveal single persons, numbers or addresses is estimated the same way from lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stranda.llm.mail import header_end
from stranda.session import beside, cut

KINDS = ("email", "person", "phone", "id_number", "address")
FOUND = "doc_id long, pii_kind string, pii_text string"
MAX_NAMES = 1_000_000

# Street words and endings of German street names.
STREET_WORDS = "Street|St|Avenue|Ave|Lane|Ln|Road|Rd|Drive|Dr|Court|Ct|Square|Sq|Way|Boulevard|Blvd|Terrace|Ter|Place|Pl|Crescent|Cres|Close|Parkway|Pkwy|Highway|Hwy|Circle|Cir"
GERMAN_ENDINGS = ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ring", "ufer", "damm", "steig", "pfad")

LOCAL = r"[A-Za-z0-9](?:[\w.+%'-]*[\w+%-])?"
LOCAL_BACK = re.compile(r"[\w.+%'-]+", re.A)
DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]")
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
SPELLED = re.compile(
    rf"(?<![\w.+%@-])({LOCAL})(?:"
    rf" at {LABEL}(?: dot {LABEL})+"
    rf"| ?[\[(]at[\])] ?{LABEL}(?:(?: ?[\[(]dot[\])] ?|\.| dot ){LABEL})+"
    r")(?![\w@-])",
    re.I | re.A,
)
OWN_IDS = re.compile(r"^(?:message-id|in-reply-to|references)[ \t]*:.*(?:\n[ \t].*)*", re.I | re.M)

# Core of a number first, for the scan's sake; what stands before and after it is looked at where the core matches.
NANP = re.compile(r"\d{3}[-. ]\d{4}")
GOES_ON = re.compile(r"[\w]|[-./]\d")
NANP_HEAD = re.compile(r"(?:(?:\+1|\b1)[-. ]?)?(?:\(\d{3}\)[-. ]?|\d{3}[-. ])$")
UK = re.compile(r"44(?:[-. ]?\(0\))?(?:[-. ]?\d){9,10}(?![\w]|[-./]?\d)")
SSN = re.compile(r"\d{3}([-. ])\d{2}\1\d{4}")
NINO = re.compile(r"[A-Z]{2}([- ]?)\d{2}[- ]?\d{2}[- ]?\d{2}[- ]?[A-D]")
AFTER_NINO = re.compile(r"[\w]|-\w")
STREET = re.compile(rf"\d{{1,6}}[A-Za-z]? (?:[^\W\d_][\w'’-]*\.? ){{1,3}}(?:{STREET_WORDS}|{STREET_WORDS.upper()})(?![\w-])")
GERMAN = re.compile(r" \d{1,5}[A-Za-z]?(?![\w]|[-./]\d)")
GERMAN_WORD = re.compile(r"(?:^|[^\w=.@/+-])([^\W\d_][\w'’.-]*)$")


# A mark is (begin, end, form, whole): a place where a form of a kind occurs, and whether it is a whole entity there.
Mark = tuple[int, int, str, bool]


def _shape(text: str, most: int = 12) -> str:
    """Runs of lower-case letters as a, of upper-case ones as A, of digits as 9, other characters as they are, cut at `most`."""
    return re.sub(r"\d+", "9", re.sub(r"[^\W\d_A-Z]+", "a", re.sub(r"[A-Z]+", "A", text)))[:most]


def emails(text: str, body_from: int) -> list[Mark]:
    found: list[Mark] = []
    at = text.find("@")
    own = [m.span() for m in OWN_IDS.finditer(text, 0, body_from)] if at >= 0 else []
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        if m:
            back = LOCAL_BACK.match(text[max(0, at - 320) : at][::-1])
            local = back[0][::-1].lstrip(".%'-") if back else ""
            begin = at - len(local)
            if local:
                mine = any(a <= begin < b for a, b in own)
                whole = local[-1] not in ".'" and ".." not in local and not mine
                found.append((begin, m.end(), f"{'own ' if mine else ''}{_shape(local)}@", whole))
            at = text.find("@", m.end())
        else:
            at = text.find("@", at + 1)
    low = text.lower()
    if " dot " in low or "[at]" in low or "(at)" in low:
        for m in SPELLED.finditer(text):
            mine = any(a <= m.start() < b for a, b in own)
            found.append((*m.span(), f"{'own ' if mine else ''}spelled {_shape(m[1])}", not mine))
    return found


def phones(text: str) -> list[Mark]:
    found: list[Mark] = []
    for m in NANP.finditer(text):
        a = m.start()
        head = NANP_HEAD.search(text[max(0, a - 12) : a])
        if head:
            begin = max(0, a - 12) + head.start()
            before = text[max(0, begin - 2) : begin]
            whole = not (before[-1:].isalnum() or before[-1:] in "+_/" or re.match(r"\d[-.(]$", before)) and not GOES_ON.match(text, m.end())
            found.append((begin, m.end(), _shape(text[begin : m.end()], 20), whole))
    at = text.find("44")
    while at >= 0:
        m = UK.match(text, at)
        if m:
            begin = at - 1 if text[at - 1 : at] == "+" else at - 2 if text[max(0, at - 2) : at] == "00" else at
            before = text[max(0, begin - 2) : begin]
            grouped = begin < at or not m[0].isdigit()
            whole = grouped and not (before[-1:].isalnum() or before[-1:] in "+_/" or re.match(r"\d[-.]$", before))
            found.append((begin, m.end(), _shape(text[begin : m.end()], 20), whole))
            if whole:
                at = m.end() - 1
        at = text.find("44", at + 1)
    return found


def _free(text: str, begin: int) -> bool:
    """Nothing before this place makes the number there part of a longer one."""
    before = text[max(0, begin - 2) : begin]
    return not (before[-1:].isalnum() or before[-1:] in "+_" or re.match(r"\w[-./,:]$", before))


def id_numbers(text: str) -> list[Mark]:
    ssn = [(*m.span(), _shape(m[0]), _free(text, m.start()) and not GOES_ON.match(text, m.end())) for m in SSN.finditer(text)]
    return ssn + [(*m.span(), _shape(m[0][2:], 20), _free(text, m.start()) and not AFTER_NINO.match(text, m.end())) for m in NINO.finditer(text)]


def addresses(text: str) -> list[Mark]:
    found: list[Mark] = []
    for m in STREET.finditer(text):
        words = m[0].split(" ")[1:]
        whole = _free(text, m.start()) and all(w[0].isupper() for w in words)
        found.append((*m.span(), f"{' '.join(_shape(w, 3) for w in words[:-1])} {words[-1].lower()}", whole))
    for m in GERMAN.finditer(text):
        a = m.start()
        word = GERMAN_WORD.search(text[max(0, a - 60) : a])
        if word:
            ending = next((e for e in GERMAN_ENDINGS if word[1].lower().endswith(e)), None)
            if ending:
                found.append((a - len(word[1]), m.end(), f"{_shape(word[1][:1])} {ending}", word[1][0].isupper() and len(word[1]) > 6))
    return found


class Names:
    """Finds persons: a given and a family name of the list, in the one order or the other."""

    def __init__(self, names: list[tuple[str, str]]):
        import ahocorasick

        given = sorted({n for n, role in names if role == "given" and n}, key=len, reverse=True)
        family = sorted({n for n, role in names if role == "family" and n}, key=len, reverse=True)
        self.automaton = ahocorasick.Automaton()
        for n in family:
            self.automaton.add_word(n.lower(), len(n.lower()))
        self.empty = not given or not family
        if not self.empty:
            self.automaton.make_automaton()
            g, f = "|".join(map(re.escape, given)), "|".join(map(re.escape, family))
            self.reach = max(map(len, given)) + 12
            self.before = re.compile(rf"(?:^|(?<=[^\w.@+-]))(?:{g})(?: +[^\W\d_]\.?)? +$", re.I)
            self.after = re.compile(rf", +(?:{g})(?![\w@-]|\.\w)(?! +(?:[^\W\d_]\.? +)?(?:{f})(?![\w@-]))", re.I)

    def persons(self, text: str) -> list[Mark]:
        """A family name of the list and whether a given name stands by it."""
        if self.empty:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found, n = [], len(text)
        for last, size in self.automaton.iter_long(low):
            begin, end = last - size + 1, last + 1
            if begin and (text[begin - 1].isalnum() or text[begin - 1] in "_@.+-") or end < n and (text[end].isalnum() or text[end] in "_@-" or text[end] in ".+" and end + 1 < n and (text[end + 1].isalnum() or text[end + 1] == "@")):
                continue
            head = text[max(0, begin - self.reach) : begin]
            m = self.before.search(head)
            if m:
                found.append((begin - len(head) + m.start(), end, low[begin:end], True))
            else:
                m = self.after.match(text, end)
                found.append((begin, m.end() if m else end, low[begin:end], m is not None))
        return found


def _cut_off(text: str, a: int, b: int) -> bool:
    """A soft line break of an encoded part stands amid the entity: it has one end here, the other on another line."""
    return text.startswith(("=\n", "=\r\n"), b) and text[b : b + 4].replace("=", "", 1).lstrip("\r\n")[:1].isalnum()


def marks(text: str, names: Names) -> list[tuple[int, int, str, str, bool]]:
    """(begin, end, kind, form, whole) of each place where a form of a kind occurs. None runs over a line end."""
    mails = emails(text, header_end(text))
    out = [(*m, "email") for m in mails]
    taken = sorted((a, b) for a, b, _, whole in mails if whole)
    persons = names.persons(text)
    apart = {(a, b) for a, b, _ in _apart(sorted({m[:2] for m in persons}), taken, "person")}
    out += [(a, b, form, whole and (a, b) in apart, "person") for a, b, form, whole in persons]
    for kind, find_ in (("phone", phones), ("id_number", id_numbers), ("address", addresses)):
        out += [(*m, kind) for m in find_(text)]
    return [(a, b, kind, form, whole and not _cut_off(text, a, b)) for a, b, form, whole, kind in out]


def spans(text: str, names: Names, disclosing: frozenset | None = None) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of every whole entity, by place; with a set of (kind, form) of those of disclosing forms alone."""
    return sorted({(a, b, kind) for a, b, kind, form, whole in marks(text, names) if whole and (disclosing is None or (kind, form) in disclosing)})


def _apart(new: list[tuple[int, int]], taken: list[tuple[int, int]], kind: str) -> list[tuple[int, int, str]]:
    """Spans that overlap none of the taken ones, both in order of place."""
    import bisect

    begins = [a for a, _ in taken]
    out = []
    for a, b in new:
        i = bisect.bisect_left(begins, b)
        if not (i and taken[i - 1][1] > a):
            out.append((a, b, kind))
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each entity as [KIND]; of overlapping ones the first, of equal begins the longest."""
    out, at = [], 0
    for a, b, kind in sorted(found, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join(out) + text[at:]


def _name_list(names: DataFrame) -> list[tuple[str, str]]:
    """The list of name parts, a reference table of at most MAX_NAMES rows, which travels with the tasks."""
    rows = [(r[0], r[1]) for r in names.select("name_text", "name_role").where("name_text is not null").limit(MAX_NAMES + 1).collect()]
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} name parts")
    return rows


BITS = 1.0
MAX_FORMS = 4_000_000
MARKS = "doc_id long, kind string, form string, text string, n long, n_whole long"


def _marked(docs: DataFrame, names: DataFrame, strings: bool = True) -> DataFrame:
    """In one scan of whole texts: the different strings of each document's whole entities (doc_id, kind, form, text);
    and, with a null text, partial counts of the occurrences of each form and of its whole ones, and, with a null kind, of
    the words of the corpus."""
    listed = docs.sparkSession.sparkContext.broadcast(_name_list(names))
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Names(listed.value)
        for batch in batches:
            rows, seen, whole_seen, words = [], Counter(), Counter(), 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                words += text.count(" ") + text.count("\n") + 1
                found = set()
                for a, b, kind, form, whole in marks(text, known):
                    seen[kind, form] += 1
                    if whole:
                        whole_seen[kind, form] += 1
                        found.add((kind, form, text[a:b]))
                if strings:
                    rows += [(doc, *f, None, None) for f in sorted(found)]
            rows += [(None, *f, None, n, whole_seen[f]) for f, n in seen.items()] + [(None, None, None, None, words, None)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "kind", "form", "text", "n", "n_whole"])

    return docs.select("doc_id", "text").mapInArrow(run, MARKS)


def _disclosing(marked: DataFrame, bits: float) -> DataFrame:
    counts = marked.where("text is null").groupBy("kind", "form").agg(F.sum("n").alias("n"), F.sum("n_whole").alias("n_whole"))
    forms = counts.where("kind is not null and n_whole > 0")
    kinds = forms.groupBy("kind").agg(F.sum("n_whole").alias("n_kind"))
    whole = beside(forms.join(kinds, "kind"), counts.where("kind is null").agg(F.sum("n").alias("n_words")))
    pmi = F.log2(F.col("n_whole").cast("double") * F.col("n_words") / (F.col("n").cast("double") * F.col("n_kind")))
    return whole.withColumn("pmi_bits", F.round(pmi, 6)).where(F.col("pmi_bits") >= bits).select("kind", "form", "n", "n_whole", "n_kind", "n_words", "pmi_bits")


def disclosing_forms(docs: DataFrame, names: DataFrame, bits: float = BITS) -> DataFrame:
    """kind, form, n, n_whole, n_kind, n_words, pmi_bits: the forms that tell at least `bits` about a kind.

    n are the occurrences of the form, n_whole those that are whole entities, n_kind the kind's whole entities, n_words
    the corpus's words; pmi_bits is log2(n_whole * n_words / (n * n_kind)). Every occurrence in every text is counted; a
    form without a whole entity tells nothing.
    """
    return _disclosing(_marked(docs, names, strings=False), bits)


def find(docs: DataFrame, names: DataFrame, bits: float = BITS) -> DataFrame:
    """doc_id, pii_kind, pii_text: the different strings of each kind in a document, as they stand in it.

    They are the whole entities of the forms that disclose their kind (see disclosing_forms): what the corpus says a form
    gives away decides, the exact check of its surroundings follows. One scan of whole texts, whose strings and counts are
    written once and joined by form. Null and empty texts have none; a doc_id that stands in two rows gives the strings of
    each row.
    """
    marked = cut(_marked(docs, names))
    forms = _disclosing(marked, bits).select("kind", "form")
    return marked.where("text is not null").join(forms, ["kind", "form"], "left_semi").select("doc_id", F.col("kind").alias("pii_kind"), F.col("text").alias("pii_text"))


def redacted(docs: DataFrame, names: DataFrame, bits: float = BITS) -> DataFrame:
    """doc_id, text, n_replaced: each text with the entities of disclosing forms replaced, one row a document; null stays
    null. Two scans, one for the forms; these are names of the list and masks of bounded length, at most MAX_FORMS."""
    sc = docs.sparkSession.sparkContext
    listed = sc.broadcast(_name_list(names))
    rows = disclosing_forms(docs, names, bits).select("kind", "form").limit(MAX_FORMS + 1).collect()
    if len(rows) > MAX_FORMS:
        raise ValueError(f"more than {MAX_FORMS} forms")
    forms = sc.broadcast(frozenset(map(tuple, rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Names(listed.value)
        for batch in batches:
            texts, counts = [], []
            for text in batch.column(1).to_pylist():
                found = spans(text, known, forms.value) if text else []
                texts.append(redact(text, found) if text else text)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["doc_id", "text", "n_replaced"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, n_replaced int")


TERM = re.compile(r"[^\W_]{3,}")


ROWS = 100_000
FEW_TERMS = 500_000
FACTS = "doc_id long, kind string, entity string, term string, n long"


def _entity(kind: str, text: str) -> str:
    """One form of what is written differently: persons by their name words, numbers by their letters and digits."""
    words = re.findall(r"[^\W_]+", text.lower())
    if kind == "person":
        return " ".join(sorted(w for w in words if len(w) > 2) or words)
    return text.lower() if kind == "email" else " ".join(words) if kind == "address" else "".join(words)


def _lines(text: str, found: list[tuple[int, int, str]]) -> Iterator[tuple[set, set]]:
    """The entities (kind, entity) and the other terms of each line of a text, headers too, that isn't blank; found are the
    text's entities."""
    k, at = 0, 0
    for line in text.split("\n"):
        end, inside = at + len(line), []
        while k < len(found) and found[k][0] < end:
            inside.append(found[k])
            k += 1
        if line.strip():
            rest = redact(line, [(a - at, min(b, end) - at, "") for a, b, _ in inside])
            yield {(kind, _entity(kind, text[a:b])) for a, b, kind in inside}, set(TERM.findall(rest.lower()))
        at = end + 1


def _facts(docs: DataFrame, names: DataFrame, pairs_only: bool = False) -> DataFrame:
    """doc_id, kind, entity, term, n: in how many lines of a document an entity and a term stand together; and, with a
    null doc_id, partial counts of the lines with a term (entity null), with an entity (term null) and of all lines."""
    listed = docs.sparkSession.sparkContext.broadcast(_name_list(names))
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "kind", "entity", "term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Names(listed.value)
        for batch in batches:
            rows, terms_seen, entities_seen, lines = [], Counter(), Counter(), 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = Counter()
                for entities, terms in _lines(text, spans(text, known)) if text else ():
                    pairs.update((*e, t) for e in entities for t in terms)
                    if not pairs_only:
                        terms_seen.update(terms)
                        entities_seen.update(entities)
                        lines += 1
                rows += [(doc, *p, n) for p, n in pairs.items()]
                if len(rows) >= ROWS:
                    yield out(rows)
                    rows = []
            rows += [(None, None, None, t, n) for t, n in terms_seen.items()] + [(None, *e, None, n) for e, n in entities_seen.items()]
            yield out(rows + ([(None, None, None, None, lines)] if lines else []))

    return docs.select("doc_id", "text").mapInArrow(run, FACTS)


def disclosing_terms(docs: DataFrame, names: DataFrame, bits: float = 3.0, sure: float = 0.5, support: int = 5) -> DataFrame:
    """term, kind, entity, n_both, n_term, n_entity, pmi_bits: the terms that give a protected entity of any kind away.

    Counted over all lines of all documents, headers too, whether an entity stands in them or not: n_both are the lines
    with both, n_term and n_entity those with either. A term discloses an entity if the pair stands in at least `support`
    documents, the entity stands in at least the share `sure` of the term's lines, and the term tells at least `bits`
    about the entity (pointwise mutual information, base 2). `support` leaves terms of fewer documents as they are: the
    rarest ones, which may disclose most, are not generalised. Counts are aggregated on both sides of the shuffle and
    kept once; a term that stands everywhere is one row an entity there.
    """
    counts = cut(_facts(docs, names).groupBy("kind", "entity", "term").agg(F.sum("n").alias("n"), F.count("doc_id").alias("n_docs")))
    pairs = counts.where((F.col("n_docs") >= support) & F.col("kind").isNotNull() & F.col("term").isNotNull()).select("kind", "entity", "term", F.col("n").alias("n_both"))
    by_term = counts.where(F.col("kind").isNull() & F.col("term").isNotNull()).select("term", F.col("n").alias("n_term"))
    by_entity = counts.where(F.col("kind").isNotNull() & F.col("term").isNull()).select("kind", "entity", F.col("n").alias("n_entity"))
    total = counts.where(F.col("kind").isNull() & F.col("term").isNull()).agg(F.sum("n").alias("n_all"))
    frequent = pairs.join(by_term, "term").where(F.col("n_both") >= sure * F.col("n_term")).join(by_entity, ["kind", "entity"])
    strong = beside(frequent, total)
    pmi = F.log2(F.col("n_both").cast("double") * F.col("n_all") / (F.col("n_term").cast("double") * F.col("n_entity")))
    return strong.withColumn("pmi_bits", F.round(pmi, 6)).where(F.col("pmi_bits") >= bits).select("term", "kind", "entity", "n_both", "n_term", "n_entity", "pmi_bits")


def sanitised(docs: DataFrame, names: DataFrame, bits: float = 3.0, sure: float = 0.5, support: int = 5) -> DataFrame:
    """doc_id, text: each text with its entities replaced and its disclosing terms generalised to [TERM] or [NUMBER].

    A document's terms are those that stand in a line with the entity they disclose; they are generalised in the whole
    text, headers too. Up to FEW_TERMS disclosing pairs, which are counted first, travel with the tasks, and a second scan
    of the corpus finds and replaces without a shuffle; more come by joins of term rows. One row for each row of docs,
    null stays null. What `support` leaves behind, see disclosing_terms.
    """
    strong = cut(disclosing_terms(docs, names, bits, sure, support).select("kind", "entity", "term"))
    sc = docs.sparkSession.sparkContext
    listed = sc.broadcast(_name_list(names))
    few = strong.count() <= FEW_TERMS
    by_entity: dict[tuple[str, str], set[str]] = {}
    for kind, entity, term in strong.collect() if few else ():
        by_entity.setdefault((kind, entity), set()).add(term)
    told = sc.broadcast(by_entity)

    def clean(text: str, found: list[tuple[int, int, str]], terms: set[str]) -> str:
        if terms:
            at = [m.span() for m in TERM.finditer(text) if m[0].lower() in terms]
            found = found + [(a, b, "number" if text[a:b].isdigit() else "term") for a, b, _ in _apart(at, [s[:2] for s in found], "")]
        return redact(text, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs = Names(listed.value), told.value
        for batch in batches:
            out = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    found = spans(text, known)
                    if few:
                        # Lines are looked at where the text has an entity that some term discloses.
                        named = any((kind, _entity(kind, text[a:b])) in pairs for a, b, kind in found)
                        terms = {t for entities, near in _lines(text, found) for e in entities if e in pairs for t in near & pairs[e]} if named else set()
                    else:
                        terms = set(batch.column(2)[k].as_py() or ())
                    text = clean(text, found, terms)
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    if few:
        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")
    mine = _facts(docs, names, pairs_only=True).join(strong, ["kind", "entity", "term"]).groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    return docs.select("doc_id", "text").join(mine, "doc_id", "left").mapInArrow(run, "doc_id long, text string")
