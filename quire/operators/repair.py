"""Repair of encoded ledgers: of their text, line by line, and of their triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.triples import TYPE

#: Name spaces of the encodings and the collection they belong to.
BK = "https://gams.uni-graz.at/o:depcha.bookkeeping#"
GAMS = "https://gams.uni-graz.at/o:gams-ontology#"
COLLECTION = "https://gams.uni-graz.at/context:arec"
#: Agents that only point back to somebody, and the properties that name agents.
BACK_REFERENCES = [
    "idem", "eidem", "eadem", "eodem", "eundem", "eandem", "earundem", "eorundem", "eiusdem", "iidem", "isdem", "iisdem", "eisdem", "eaedem",
    "eosdem", "easdem", "ipse", "ipsa", "ipsum", "ipsius", "ipsi", "ipsam", "ipso", "ipsorum", "ipsarum", "ipsis", "ipsos", "ipsas", "eius", "eum",
    "eam", "eorum", "earum", "eis", "eos", "eas", "sibi", "sese", "secum", "predictus", "predicto", "predicti", "prefatus", "prefato", "dictus",
    "dicto", "dicti", "supradictus", "supradicto", "derselbe", "demselben", "denselben", "dieselbe", "demselbigen", "denselbigen",
]
AGENT_PROPERTIES = ["from", "to", "by", "credit", "debit"]
#: Properties that hold one amount or thing each, and the classes they hold.
SINGLE_PROPERTIES = ["transfers", "ows", "consistsOf"]
THINGS = ["Money", "Commodity", "Service", "Right", "Debt"]
MEMBERS = ["Transaction", "TotalTransaction", "Note"]


def commented(text: Column) -> Column:
    """Lines that are no XML, and nested declarations and wrappers, as comments; what is in comments stays. Whole lines only."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("inside"))

    def step(acc: Column, line: Column) -> Column:
        bare = F.trim(line)
        closes, opens = F.contains(line, F.lit("-->")), F.contains(line, F.lit("<!--"))
        within = acc["inside"] | opens
        wrapper = bare.rlike(r"^(<\?xml|</?rdf:RDF)")
        made = F.when(within | closes, line).when(wrapper | ((bare != "") & ~bare.startswith("<")), F.concat(F.lit("<!-- "), bare, F.lit(" -->"))).otherwise(line)
        return F.struct(F.concat(acc["out"], F.array(made)).alias("out"), F.when(closes, F.lit(False)).otherwise(within).alias("inside"))

    return F.aggregate(F.split(text, r"\r?\n"), start, step, lambda acc: F.array_join(acc["out"], "\n"))


def cleaned(text: Column) -> Column:
    """Without code fences, stray name spaces, empty comments and blank lines; the unit #stück is #piece, the word in texts stays."""
    for gone in ("<!-- --- -->", "``````xml", "```xml", "```rdf", "```", ' xmlns:bk="https://gams.uni-graz.at/context:arec#"', "<!--  -->"):
        text = F.replace(text, F.lit(gone), F.lit(""))
    text = F.regexp_replace(text, r"(bk:Transaction) xmlns:rdf=\"http://www\.w3\.org/1999/02/22-rdf-syntax-ns#\"", "$1")
    text = F.regexp_replace(text, r"\n\s*\n", "\n")
    text = F.regexp_replace(text, r"(?iu)(?<=#)st[üu]ck\b", "piece")
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def with_membership(triples: DataFrame) -> DataFrame:
    """Adds, where missing, that an entry belongs to the collection and is part of its file."""
    local = F.regexp_extract("o", r"([^#/]*)$", 1)
    members = triples.where((F.col("p") == TYPE) & local.isin(*MEMBERS) & F.contains("s", F.lit("#"))).select("graph", "s").distinct()
    wanted = members.select("graph", "s", F.lit(GAMS + "isMemberOfCollection").alias("p"), F.lit(COLLECTION).alias("o")).union(
        members.select("graph", "s", F.lit(GAMS + "isPartOf").alias("p"), F.substring_index("s", "#", 1).alias("o"))
    )
    new = wanted.join(triples.select("graph", "s", "p").distinct(), ["graph", "s", "p"], "left_anti")
    return triples.unionByName(new.withColumn("o_kind", F.lit("uri")), allowMissingColumns=True)


def split_properties(properties: DataFrame) -> DataFrame:
    """Rows (host, property, children array<struct<id, class>>) to one row for each child where a single-valued property holds several of one class.

    All children are kept, those of other classes as well.
    """
    per_class = F.array_max(F.transform(F.lit(THINGS), lambda t: F.size(F.filter("children", lambda c: c["class"] == t))))
    several = F.col("property").isin(*SINGLE_PROPERTIES) & (per_class > 1)
    pieces = F.when(several, F.transform("children", lambda c: F.array(c))).otherwise(F.array("children"))
    rest = [c for c in properties.columns if c != "children"]
    return properties.select(*rest, several.alias("was_split"), F.posexplode(pieces).alias("piece", "children"))


def without_back_references(triples: DataFrame) -> DataFrame:
    """Agents named by a word that points back become #anonymous; only the fragment changes."""
    name = F.lower(F.substring_index("o", "#", -1))
    local = F.regexp_extract("p", r"([^#/]*)$", 1)
    back = local.isin(*AGENT_PROPERTIES) & F.contains("o", F.lit("#")) & name.isin(*BACK_REFERENCES)
    return triples.withColumn("o", F.when(back, F.regexp_replace("o", r"#[^#]*$", "#anonymous")).otherwise(F.col("o")))


def resolved_dates(phrases: DataFrame, phrase: str = "phrase", year: str = "year") -> DataFrame:
    """Adds iso, precision and reason; unresolved phrases get the bare year, and ambiguous marks names."""
    from quire.functions.dates import resolve_phrase

    out = phrases.withColumn("__d", resolve_phrase(F.col(phrase), F.col(year).try_cast("int")))
    out = out.withColumn("iso", F.coalesce("__d.iso", F.col(year).cast("string"))).withColumn("precision", F.coalesce("__d.precision", F.lit("year")))
    return out.withColumn("reason", F.col("__d.reason")).withColumn("ambiguous", F.col("__d.ambiguous")).drop("__d")
