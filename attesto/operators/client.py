"""Derivations that readers of verdicts make: staleness, provenance, filters, groups, short texts, closing points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of verdict groups: problems first.
PRIORITY = {"ko": 0, "warn": 1, "pending": 2, "na": 3, "ok": 4}


def short_status(status: Column) -> Column:
    return F.when(status == "CONFORME", "ok").when(status == "NON_CONFORME", "ko").when(status == "AVERTISSEMENT", "warn").when(status == "NON_APPLICABLE", "na").otherwise("pending")


def answer_status(answer: Column) -> Column:
    """A checklist answer as a status."""
    return F.when(answer, "ok").when(~answer, "ko").otherwise("na")


def engine(rule: Column, source: Column) -> Column:
    return F.when(rule.startswith("CUSTOM-") | source.startswith("CUSTOM"), "ai").when(source.isin("CHECKLIST", "HUMAIN"), "human").otherwise("system")


def stale(verdicts: DataFrame, documents: DataFrame) -> DataFrame:
    """Verdicts with ``perime``: a document that they cite was uploaded after they were given."""
    cited = verdicts.select("dossier_id", "regle", "execution", F.explode("document_ids").alias("document_id"))
    late = cited.join(documents.select("document_id", "upload"), "document_id").filter("upload > execution").select("dossier_id", "regle").distinct().withColumn("perime", F.lit(True))
    return verdicts.join(late, ["dossier_id", "regle"], "left").withColumn("perime", F.coalesce("perime", F.lit(False)))


def shown(verdicts: DataFrame, mode: str | None = None, by: str | None = None, text: str | None = None) -> DataFrame:
    """Verdicts of a mode (``problems``, ``conforme``, ``pending``), an engine and a text in rule or detail; null does not filter."""
    modes = {"problems": ["ko", "warn"], "conforme": ["ok"], "pending": ["pending", "na"]}
    test = F.lit(True) if mode is None else short_status(F.col("statut")).isin(*modes[mode])
    if by is not None:
        test = test & (engine(F.col("regle"), F.col("source")) == by)
    if text is not None:
        test = test & F.contains(F.lower(F.concat_ws(" ", "regle", "detail")), F.lit(text.lower()))
    return verdicts.filter(test)


def grouped(verdicts: DataFrame) -> DataFrame:
    """Per file and group: its verdicts and their count, problems first."""
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair]), F.col("groupe"))
    out = verdicts.withColumn("groupe", short_status(F.col("statut"))).groupBy("dossier_id", "groupe").agg(F.count(F.lit(1)).alias("nb"), F.array_join(F.array_sort(F.collect_list("regle")), ",").alias("regles"))
    return out.withColumn("rang", rank)


def mini_verdict(status: Column, expected: Column, found: Column, detail: Column) -> Column:
    """For failures and warnings: expected against found, else the first sentence, 80 characters at most."""
    sentence = F.split(detail, r"[.;\n]")[0]
    said = F.when((expected != "") & (found != ""), F.concat(expected, F.lit(" ≠ "), found)).otherwise(sentence)
    return F.when(status.isin("NON_CONFORME", "AVERTISSEMENT"), F.substring(F.trim(said), 1, 80))


def checklist_points(json: DataFrame) -> DataFrame:
    """Points of a JSON checklist (dossier_id, points) with number and label, by position where they have none."""
    schema = "array<struct<numero:int,libelle:string,valide:boolean>>"
    rows = json.select("dossier_id", F.posexplode(F.from_json("points", schema)).alias("pos", "p"))
    return rows.select("dossier_id", F.coalesce("p.numero", F.col("pos") + 1).alias("numero"), F.coalesce("p.libelle", F.concat(F.lit("Point "), F.col("pos") + 1)).alias("libelle"), "p.valide")


#: The points of a file without a checklist.
DEFAULT_POINTS = (
    "Concordance facture / modalites contractuelles / livrables", "Verification arithmetique des montants", "Respect du delai d'execution des prestations", "Modifications / avenants (plafonds et variations)",
    "Application des retenues et penalites", "Signatures et visas des personnes habilitees", "Conformite reglementaire (ICE, IF, RC, CNSS)", "Conformite du RIB contractuel vs facture", "Conformite BL / PV de reception",
    "Habilitations des signataires des receptions",
)


def control_points(rows: DataFrame) -> DataFrame:
    """The points of the control table of each file (``typed.dossier_rows``): dossier_id, rang, description, observation, commentaire; those of its checklist, else the default ones."""
    one = lambda description, observation, comment: F.struct(description.alias("description"), observation.alias("observation"), comment.alias("commentaire"))
    own = F.transform(F.col("checklist_autocontrole")["points"], lambda p: one(
        F.coalesce(p["description"], F.concat(F.lit("Point "), p["numero"].cast("string"))), F.when(p["est_valide"], "Conforme").when(~p["est_valide"], "Non conforme").otherwise("NA"), p["observation"]))
    default = F.array(*[one(F.lit(x), F.lit("NA"), F.lit(None).cast("string")) for x in DEFAULT_POINTS])
    return rows.select("dossier_id", F.posexplode(F.when(F.size(own) > 0, own).otherwise(default)).alias("rang", "p")).select("dossier_id", (F.col("rang") + 1).alias("rang"), "p.*")


def closing_points(points: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each point (dossier_id, numero, libelle, valide) with its conclusion: of the first verdict whose text holds the other's first 20 characters, else the answer."""
    head = lambda c: F.substring(F.lower(c), 1, 20)
    v = verdicts.select("dossier_id", "regle", F.col("libelle").alias("texte"), "statut")
    near = F.contains(F.lower("texte"), head("libelle")) | F.contains(F.lower("libelle"), head("texte"))
    found = points.join(v, "dossier_id").filter(near)
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("dossier_id", "numero").orderBy("regle"))).filter("n = 1").select("dossier_id", "numero", "statut")
    said = F.when(F.col("statut") == "CONFORME", "Conforme").when(F.col("statut") == "NON_CONFORME", "Non conforme").when(F.col("statut").isNotNull(), "NA")
    return points.join(first, ["dossier_id", "numero"], "left").select("dossier_id", "numero", F.coalesce(said, F.when(F.col("valide"), "Conforme").when(~F.col("valide"), "Non conforme").otherwise("NA")).alias("conclusion"))


def closing_counts(conclusions: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("conclusion") == s)
    return conclusions.groupBy("dossier_id").agg(F.count_if(F.col("conclusion") != "NA").alias("actifs"), is_("Conforme").alias("conformes"), is_("Non conforme").alias("non_conformes"))


def rules_by_field(rules: DataFrame) -> DataFrame:
    """From (regle, champs) each field, and the part before its first point, with the rules that read it."""
    flat = rules.select("regle", F.explode("champs").alias("champ"))
    both = flat.unionAll(flat.select("regle", F.substring_index("champ", ".", 1)))
    return both.groupBy("champ").agg(F.array_join(F.array_sort(F.collect_set("regle")), ",").alias("regles"))
