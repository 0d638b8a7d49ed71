"""The ontology tables: schemata, their lineage and their entity-typed properties.

The tables are small fixed vocabularies (tens of rows), so they are literals in
expressions.  They hold the public model's schemata; another or wider ontology is
given as tuples of the same form to the functions that take ``schemata``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Schema, parents, whether it is an edge, whether it is matched.
SCHEMATA = (
    ("Thing", (), False, True),
    ("LegalEntity", ("Thing",), False, True),
    ("Person", ("LegalEntity",), False, True),
    ("Organization", ("LegalEntity",), False, True),
    ("Asset", ("Thing",), False, True),
    ("Company", ("Organization", "Asset"), False, True),
    ("PublicBody", ("Organization",), False, True),
    ("Vehicle", ("Asset",), False, True),
    ("Vessel", ("Vehicle",), False, True),
    ("Airplane", ("Vehicle",), False, True),
    ("RealEstate", ("Asset",), False, True),
    ("Security", ("Asset",), False, True),
    ("BankAccount", ("Asset",), False, True),
    ("CryptoWallet", ("Thing",), False, True),
    ("Contract", ("Asset",), False, False),
    ("License", ("Contract",), False, False),
    ("Position", ("Thing",), False, False),
    ("CourtCase", ("Thing",), False, False),
    ("Project", ("Thing",), False, False),
    ("Assessment", ("Thing",), False, False),
    ("Note", ("Thing",), False, False),
    ("Document", ("Thing",), False, False),
    ("Folder", ("Document",), False, False),
    ("Package", ("Folder",), False, False),
    ("Workbook", ("Folder",), False, False),
    ("Email", ("Folder",), False, False),
    ("Table", ("Document",), False, False),
    ("HyperText", ("Document",), False, False),
    ("PlainText", ("Document",), False, False),
    ("Pages", ("Document",), False, False),
    ("Image", ("Document",), False, False),
    ("Audio", ("Document",), False, False),
    ("Video", ("Document",), False, False),
    ("Trip", ("Event",), False, False),
    ("Mention", (), False, False),
    ("Identification", (), False, False),
    ("Passport", ("Identification",), False, False),
    ("TaxRoll", (), False, False),
    ("EconomicActivity", (), False, False),
    ("Call", (), False, False),
    ("Message", (), False, False),
    ("ContractAward", (), False, False),
    ("Address", ("Thing",), False, True),
    ("Article", ("Thing",), False, False),
    ("Event", ("Thing",), False, False),
    ("UserAccount", ("Thing",), False, True),
    ("Indicator", ("Thing",), False, False),
    ("Sanction", ("Thing",), False, False),
    ("Ownership", (), True, False),
    ("Directorship", (), True, False),
    ("Membership", (), True, False),
    ("UnknownLink", (), True, False),
    ("Associate", (), True, False),
    ("Family", (), True, False),
    ("Employment", (), True, False),
    ("Representation", (), True, False),
    ("Occupancy", (), True, False),
    ("Succession", (), True, False),
    ("Debt", (), True, False),
    ("Payment", (), True, False),
    ("Documentation", (), True, False),
    ("CourtCaseParty", (), True, False),
    ("ProjectParticipant", (), True, False),
    ("Similar", (), True, False),
)
# Entity-typed properties of nodes: schema, property, label of the link, range.
LINKS = (
    ("LegalEntity", "addressEntity", "ADDRESS_ENTITY", "Address"),
    ("Event", "addressEntity", "ADDRESS_ENTITY", "Address"),
    ("Event", "involved", "INVOLVED", "Thing"),
    ("Event", "proof", "PROOF", "Thing"),
    ("Indicator", "indicates", "INDICATES", "Organization"),
    ("Sanction", "entity", "ENTITY", "Thing"),
)
# Edge schemata: source property, target property, label.
EDGES = {
    "Ownership": ("owner", "asset", "OWNS"),
    "Directorship": ("director", "organization", "DIRECTS"),
    "Membership": ("member", "organization", "MEMBER_OF"),
    "UnknownLink": ("subject", "object", "LINKED"),
    "Associate": ("person", "associate", "ASSOCIATE_OF"),
    "Family": ("person", "relative", "RELATED_TO"),
    "Employment": ("employee", "employer", "EMPLOYED_BY"),
    "Representation": ("agent", "client", "REPRESENTS"),
    "Occupancy": ("holder", "post", "HOLDS"),
    "Succession": ("predecessor", "successor", "SUCCEEDED_BY"),
    "Debt": ("debtor", "creditor", "OWES"),
    "Payment": ("payer", "beneficiary", "PAID"),
    "Documentation": ("document", "entity", "DOCUMENTS"),
    "CourtCaseParty": ("party", "case", "PARTY_IN"),
    "ProjectParticipant": ("participant", "project", "TAKES_PART_IN"),
    "Similar": ("candidate", "match", "SIMILAR_TO"),
}
# Topics that mean risk.
RISKS = (
    "corp.disqual crime crime.boss crime.fin crime.fraud crime.terror crime.theft crime.traffick crime.war debarment export.control "
    "export.control.linked export.risk invest.ban invest.risk mare.detained mare.shadow poi reg.action reg.warn role.oligarch role.pep role.rca "
    "sanction sanction.control sanction.counter sanction.linked wanted"
).split()
#: Topics known to carry no risk; a parameter wherever it matters.
BENIGN_TOPICS = ("role.pep.natl", "role.pep.intl", "role.pep.frmr", "crime.cyber", "gov", "fin", "corp.public", "media", "asset.frozen")

Schemata = tuple[tuple[str, tuple[str, ...], bool, bool], ...]
NAMES = tuple(s for s, *_ in SCHEMATA)


def lineage(schema: str, schemata: Schemata = SCHEMATA) -> set[str]:
    """A schema and all its ancestors."""
    parents = {s: p for s, p, *_ in schemata}
    return {schema, *(a for p in parents.get(schema, ()) for a in lineage(p, schemata))}


def common_schema(a: str, b: str, schemata: Schemata = SCHEMATA) -> str | None:
    """The narrower of two schemata of one lineage, null if they share none."""
    if a in lineage(b, schemata):
        return b
    return a if b in lineage(a, schemata) else None


def common_pairs(schemata: Schemata = SCHEMATA) -> list[tuple[str, str, str]]:
    """``(schema, schema, common)``: the pairs that can be merged, both ways round."""
    up = {s: lineage(s, schemata) for s, *_ in schemata}
    return [(a, b, b if a in up[b] else a) for a in up for b in up if a in up[b] or b in up[a]]


def compatibility(spark: SparkSession, schemata: Schemata = SCHEMATA) -> DataFrame:
    """``(schema_l, schema_r, common)``: the pairs that can be merged; some hundred rows, as schemata have few ancestors."""
    return spark.createDataFrame(common_pairs(schemata), "schema_l string, schema_r string, common string")


def _in(c: Column, names) -> Column:
    return c.isin(*names) if names else F.lit(False)


def is_edge(schema: Column, schemata: Schemata = SCHEMATA) -> Column:
    return _in(schema, [s for s, _, e, _ in schemata if e])


def matchable(schema: Column, schemata: Schemata = SCHEMATA) -> Column:
    """Schemata that take part in matching; an unknown one does."""
    return ~_in(schema, [s for s, _, e, m in schemata if e or not m])


def link_label(schema: Column, prop: Column, schemata: Schemata = SCHEMATA, links=LINKS) -> Column:
    """Label of the link that an entity-typed property makes, null for other properties."""
    out = F.lit(None).cast("string")
    for s, p, label, *_ in links:
        kinds = [x for x, *_ in schemata if s in lineage(x, schemata)]
        out = F.when((prop == p) & schema.isin(*kinds), label).otherwise(out)
    return out


def entity_typed(schema: Column, prop: Column, schemata: Schemata = SCHEMATA, links=LINKS, edges=EDGES) -> Column:
    """Whether the values of a property are ids of entities: links of nodes, and both ends of edges."""
    out = link_label(schema, prop, schemata, links).isNotNull()
    for s, (source, target, _) in edges.items():
        out = out | ((schema == s) & prop.isin(source, target))
    return F.coalesce(out, F.lit(False))


def common_of(schemata: Column, known: Schemata = SCHEMATA) -> Column:
    """The common schema of a sorted array of schemata; the first stays where no schema is common."""
    pairs = [(a, b, c) for a, b, c in common_pairs(known) if c != a]
    table = F.create_map(*[x for a, b, c in pairs for x in (F.lit(f"{a}|{b}"), F.lit(c))])
    return F.aggregate(schemata, F.get(schemata, F.lit(0)), lambda acc, s: F.coalesce(F.try_element_at(table, F.concat_ws("|", acc, s)), acc))


def topic_label(code: Column) -> Column:
    """Node label of a topic code: each part with a capital, ``sanction.linked`` to ``SanctionLinked``."""
    return F.concat_ws("", F.transform(F.split(code, r"\."), F.initcap))


def is_sensitive(topics: Column, vocabulary: tuple[str, ...] = BENIGN_TOPICS) -> Column:
    """Deny by default: a risk, a code below a risk, or a code outside the vocabulary; no topics are benign."""
    below = F.exists(topics, lambda t: reduce(lambda a, b: a | b, (t.startswith(r + ".") for r in RISKS)))
    known = F.array(*map(F.lit, (*RISKS, *vocabulary)))
    return F.coalesce(F.arrays_overlap(topics, F.array(*map(F.lit, RISKS))) | below | (F.size(F.array_except(topics, known)) > 0), F.lit(False))


# Topics of the older test.
OLD_RISKS = ("sanction", "sanction.linked", "poi", "crime", "crime.fraud", "crime.terror", "wanted")


def was_sensitive(topics: Column) -> Column:
    """The older, narrower test: some codes, and any that begin like political or sanctioned ones."""
    return F.coalesce(F.exists(topics, lambda t: t.isin(*OLD_RISKS) | t.startswith("role.pep") | t.startswith("sanction")), F.lit(False))


def newly_sensitive(topics: Column, vocabulary: tuple[str, ...] = BENIGN_TOPICS) -> Column:
    return is_sensitive(topics, vocabulary) & ~was_sensitive(topics)
