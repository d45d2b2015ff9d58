"""Typed rows of extracted documents and engagements, and the cache of recognised texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesto.functions import scalars
from attesto.operators import quality

#: The fields of each type that have a column, and how they are read.
FIELDS = {
    "FACTURE": {
        "numeroFacture": "text", "dateFacture": "date", "fournisseur": "text", "client": "text", "ice": "text", "identifiantFiscal": "text", "rc": "text", "rib": "text", "ribs": "strings", "montantHT": "amount", "montantTVA": "amount",
        "tauxTVA": "amount", "montantTTC": "amount", "devise": "upper", "dateReceptionFacture": "date", "referenceContrat": "text", "periode": "text", "typeFacture": "text",
    },
    "BON_COMMANDE": {"reference": "text", "dateBc": "date", "fournisseur": "text", "objet": "text", "montantHT": "amount", "montantTVA": "amount", "tauxTVA": "amount", "montantTTC": "amount", "signataire": "text", "ice": "text"},
    "CONTRAT_AVENANT": {"referenceContrat": "text", "numeroAvenant": "text", "dateSignature": "date", "parties": "joined ,", "objet": "text", "dateEffet": "date"},
    "ORDRE_PAIEMENT": {
        "numeroOp": "text", "dateEmission": "date", "emetteur": "text", "natureOperation": "text", "description": "text", "beneficiaire": "text", "rib": "text", "ribs": "strings", "banque": "text", "modePaiement": "upper", "devise": "upper",
        "signataireOrdonnateur": "trimmed", "signataireComptable": "trimmed", "montantOperation": "amount", "montantBrut": "amount", "referenceFacture": "text", "referenceBcOuContrat": "text", "referenceSage": "text",
        "conclusionControleur": "text", "piecesJustificatives": "joined ||", "ice": "text",
    },
    "CHECKLIST_AUTOCONTROLE": {"reference": "text", "nomProjet": "text", "referenceFacture": "text", "prestataire": "text"},
    "TABLEAU_CONTROLE": {"societeGeree": "text", "referenceFacture": "text", "fournisseur": "text", "signataire": "text"},
    "PV_RECEPTION": {"titre": "text", "dateReception": "date", "referenceContrat": "text", "periodeDebut": "date", "periodeFin": "date", "prestations": "joined ,", "signataireMadaef": "text", "signataireFournisseur": "text"},
    "ATTESTATION_FISCALE": {
        "numero": "text", "dateEdition": "date", "raisonSociale": "text", "identifiantFiscal": "text", "ice": "text", "rc": "text", "estEnRegle": "flag", "dateValidite": "date", "typeAttestation": "upper", "codeVerification": "trimmed",
    },
}
#: The child lists of each type. Names apart by ``|`` are tried in order.
CHILDREN = {
    ("FACTURE", "lignes"): {"codeArticle": "filled", "designation": "trimmed", "quantite": "quantity", "unite": "filled", "prixUnitaireHT|prixUnitaireHt": "amount", "montantTotalHt|montantTotalHT|montantLigneHT": "amount"},
    ("BON_COMMANDE", "lignes"): {"codeArticle": "filled", "designation": "trimmed", "quantite": "quantity", "prixUnitaireHT|prixUnitaireHt": "amount", "montantTotalHt|montantTotalHT|montantLigneHT": "amount"},
    ("CONTRAT_AVENANT", "grillesTarifaires"): {"designation": "text", "prixUnitaireHT": "amount", "periodicite": "one of MENSUEL TRIMESTRIEL ANNUEL JOURNALIER", "entite": "text"},
    ("ORDRE_PAIEMENT", "retenues"): {"type": "one of AUTRE TVA_SOURCE IS_HONORAIRES GARANTIE", "articleCGI": "text", "base": "amount", "taux": "amount", "montant": "amount"},
    ("CHECKLIST_AUTOCONTROLE", "points"): {"numero": "number or 0", "description": "text", "estValide": "yes or no", "observation": "text"},
    ("CHECKLIST_AUTOCONTROLE", "signataires"): {"nom": "text", "date": "date", "aSignature": "flag"},
    ("TABLEAU_CONTROLE", "points"): {"numero": "number or 0", "description": "text", "observation": "text", "commentaire": "text"},
}
#: Fields of engagements that all types have, and those of one type.
ENGAGEMENT = {
    "objet": "filled", "fournisseur": "filled", "montantHt": "plain amount", "montantTva": "plain amount", "tauxTva": "plain amount", "montantTtc": "plain amount", "dateDocument": "iso date", "dateSignature": "iso date", "dateNotification": "iso date",
}
ENGAGEMENT_OF = {
    "MARCHE": {
        "numeroAo": "filled", "dateAo": "iso date", "categorie": "upper of TRAVAUX FOURNITURES SERVICES", "delaiExecutionMois": "number", "retenueGarantiePct": "plain amount", "cautionDefinitivePct": "plain amount",
        "penalitesRetardJourPct": "plain amount", "revisionPrixAutorisee": "flag",
    },
    "BON_COMMANDE_CADRE": {"plafondMontant": "plain amount", "dateValiditeFin": "iso date", "seuilAntiFractionnement": "plain amount"},
    "CONTRAT_CADRE": {
        "periodicite": "upper of MENSUEL TRIMESTRIEL SEMESTRIEL ANNUEL", "dateDebut": "iso date", "dateFin": "iso date", "reconductionTacite": "flag", "preavisResiliationJours": "number", "indiceRevision": "filled",
    },
}


def snake(name: str) -> str:
    """Column of a field: ``montantTTC`` is ``montant_ttc``."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name.split("|")[0]).lower()


def _is(value: Column, kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(f"^({kinds})"), F.lit(False))


def _string(value: Column) -> Column:
    """A JSON string; null for any other value."""
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def _shown(value: Column) -> Column:
    """An element of a list as text."""
    return F.coalesce(_string(value), F.try_variant_get(value, "$", "string"), F.lit("null"))


def amount_of(value: Column, parse=scalars.parse_amount_strict, kind: str = scalars.MONEY) -> Column:
    """A JSON number as it is, a JSON string by ``parse``; null for any other value."""
    return F.when(_is(value, "BIGINT|DECIMAL|DOUBLE|FLOAT"), F.try_variant_get(value, "$", "decimal(38,6)").try_cast(kind)).when(_is(value, "STRING"), scalars.once(F.try_variant_get(value, "$", "string"), parse).cast(kind))


def _of_text(text: Column, how: str) -> Column:
    if how == "filled":
        return F.when(F.trim(text) != "", text)
    if how == "date":
        return scalars.parse_date_typed(text)
    if how == "iso date":
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    names = how.split(" of ")[1].split(" ")
    if how.startswith("upper of "):
        return F.when(F.upper(text).isin(*names), F.upper(text))
    return F.when(text.isin(*names), text).otherwise(names[0])  # the first one is the default


def _read(value: Column, how: str) -> Column:
    """A value as ``how`` asks; ``value`` is a column or a field, and its text is worked out once for all that names it."""
    text = _string(value)
    if how == "text":
        return text
    if how in ("trimmed", "upper"):
        trimmed = scalars.once(F.trim(text), lambda t: F.nullif(t, F.lit("")))
        return trimmed if how == "trimmed" else F.upper(trimmed)
    if how in ("amount", "quantity"):
        return amount_of(value, kind="decimal(15,3)" if how == "quantity" else scalars.MONEY)
    if how == "plain amount":
        return amount_of(value, lambda t: F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(18,4)"), "decimal(18,4)")
    if how in ("number", "number or 0"):
        number = F.when(_is(value, "BIGINT|DECIMAL|DOUBLE"), F.try_variant_get(value, "$", "double").try_cast("int"))
        return number if how == "number" else F.coalesce(number, F.lit(0))
    if how == "flag":
        return F.when(_is(value, "BOOLEAN"), F.try_variant_get(value, "$", "boolean"))
    if how == "yes or no":
        return scalars.once(F.when(_is(value, "STRING|BOOLEAN|BIGINT|DECIMAL|DOUBLE"), F.try_variant_get(value, "$", "string")), scalars.parse_bool)
    return scalars.once(text, lambda t: _of_text(t, how))


def _array(how: str) -> bool:
    return how == "strings" or how.startswith("joined ")


def _schema(fields: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {'array<variant>' if _array(how) else 'variant'}" for names, how in fields.items() for name in names.split("|"))


def _scalars(fields: dict[str, str], get) -> list[Column]:
    def one(names: str, how: str) -> Column:
        if "|" in names:
            return scalars.once(F.coalesce(*[F.when(~_is(get(n), "VOID"), get(n)) for n in names.split("|")]), lambda value: _read(value, how)).alias(snake(names))
        value = get(names)
        if how == "strings":
            return F.filter(F.transform(value, _string), lambda x: x.isNotNull())
        return F.array_join(F.transform(value, _shown), how.split(" ")[1]) if how.startswith("joined ") else _read(value, how)

    return [one(names, how).alias(snake(names)) for names, how in fields.items()]


#: Other names under which a field may be corrected.
ALSO_CORRECTED = {"montantHT": "montantHt", "montantTVA": "montantTva", "tauxTVA": "tauxTva", "montantTTC": "montantTtc", "identifiantFiscal": "if", "numeroOp": "numeroOP"}


def _corrected(value: Column, name: str, how: str) -> Column:
    """A field under a person's correction of it."""
    if _array(how):
        return value
    parse = {"date": scalars.parse_date_correction, "amount": scalars.parse_amount, "flag": lambda t: scalars.parse_bool(t, numbers=False)}.get(how, lambda t: t)
    for key in (ALSO_CORRECTED.get(name), name):
        if key:
            there = F.coalesce(F.map_contains_key("corrections", F.lit(key)), F.lit(False))
            value = F.when(there, parse(F.try_element_at("corrections", F.lit(key)))).otherwise(value)
    return value.alias(snake(name))


def _children(kind: str) -> dict[str, dict[str, str]]:
    return {name: fields for (of, name), fields in CHILDREN.items() if of == kind}


def read_of(kind: str, fields: dict[str, set[str]] | None) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """The fields and the child lists of a type that are read: all, or those that ``fields`` names for it (one at least, so that the row is there)."""
    own, lists = FIELDS[kind], _children(kind)
    if fields is None:
        return own, lists
    asked = fields[kind] or {next(iter(own))}
    return {n: h for n, h in own.items() if n in asked}, {n: f for n, f in lists.items() if n in asked}


def parsed(docs: DataFrame, kinds: list[str] | None = None, fields: dict[str, set[str]] | None = None) -> DataFrame:
    """``docs`` (document_id, dossier_id, type, upload, data as JSON text) with a struct column for each type, null where the document is of another.

    A column ``corrections`` (field to value) lays a person's values over fields that were read, in the corrections' own notations; a null value
    empties the field. A text that is no JSON object makes no row. Each text is parsed once, into variants of the fields that have a column; a
    value of another JSON type than the field asks for is null. ``fields`` leaves other types, fields and lists unread.
    """
    an_object = F.coalesce(F.col("data").rlike(r"^[ \t\r\n]*\{"), F.lit(False)) & F.try_parse_json("data").isNotNull()
    out = docs.withColumn("__object", an_object)
    for kind in kinds or fields or FIELDS:
        read_fields, lists = read_of(kind, fields)
        mine = (F.col("type") == kind) & F.col("__object")
        json = F.from_json(F.when(mine, F.col("data")), ", ".join([*([_schema(read_fields)] if read_fields else []), *[f"`{n}` array<variant>" for n in lists]]))
        places = lambda fields: {n: f"v{i}" for i, n in enumerate(n for names in fields for n in names.split("|"))}
        taken = lambda at: lambda row: F.struct(*[F.try_variant_get(row, f"$.{n}", "variant").alias(v) for n, v in at.items()])
        read = lambda fields, at: lambda row: F.struct(*_scalars(fields, lambda n: row[at[n]]))
        children = [F.transform(F.transform(F.col("__json")[n], taken(places(f))), read(f, places(f))).alias(snake(n)) for n, f in lists.items()]
        if "lignes" in lists:  # lines without a designation are none
            children = [F.filter(c, lambda row: row["designation"].isNotNull()).alias("lignes") for c in children]
        own = _scalars(read_fields, lambda n: F.col("__json")[n])
        if "corrections" in docs.columns:
            own = [_corrected(value, name, how) for value, (name, how) in zip(own, read_fields.items(), strict=True)]
        out = out.withColumn("__json", json).withColumn(kind.lower(), F.when(mine, F.struct(*own, *children))).drop("__json")
    return out.drop("__object")


def dossier_rows(docs: DataFrame, fields: dict[str, set[str]] | None = None) -> DataFrame:
    """One row for each file: dossier_id, types, documents (id and type of all), factures (all, in order of upload), and a struct for each other type, null without such a document.

    Of a type that a file has once, the last document (by upload, then id) gives the fields, and the last one that has a list
    its children; the first one stays the document that the row belongs to. Everything meets in one partial aggregation by file, so no
    side is joined and no list multiplies another. With ``fields``, only these types have a column, and only these fields and lists of them are read.
    """
    order = F.struct("upload", "document_id")
    rows = parsed(docs, fields=fields)
    aggregates = [F.sort_array(F.collect_set("type")).alias("types"), F.sort_array(F.collect_list(F.struct("document_id", "type"))).alias("documents")]
    if fields is None or "FACTURE" in fields:
        own, lists = read_of("FACTURE", fields)
        invoice = F.when(F.col("facture").isNotNull(), F.struct("upload", "document_id", *[F.col("facture")[f].alias(f) for f in [*map(snake, own), *map(snake, lists)]], *[F.col(c) for c in ("texte",) if c in docs.columns]))
        aggregates.append(F.sort_array(F.collect_list(invoice)).alias("factures"))
    others = [k for k in fields or FIELDS if k != "FACTURE"]
    for kind in others:
        name = kind.lower()
        own, lists = read_of(kind, fields)
        mine = F.col(name).isNotNull()
        aggregates.append(F.min_by(F.when(mine, F.col("document_id")), F.when(mine, order)).alias(f"{name}_document"))
        aggregates.append(F.max_by(F.when(mine, F.struct(F.lit(True).alias("__la"), *[F.col(name)[snake(f)].alias(snake(f)) for f in own], *[F.col(c) for c in ("qr",) if c in docs.columns])), F.when(mine, order)).alias(f"{name}_champs"))
        for child in lists:
            there = F.col(name)[snake(child)].isNotNull()
            aggregates.append(F.max_by(F.when(there, F.col(name)[snake(child)]), F.when(there, order)).alias(f"{name}_{snake(child)}"))
    met = rows.groupBy("dossier_id").agg(*aggregates)

    def whole(kind: str) -> Column:
        name = kind.lower()
        champs = [f for f in met.schema[f"{name}_champs"].dataType.names if f != "__la"]
        row = F.struct(F.col(f"{name}_document").alias("document_id"), *[F.col(f"{name}_champs")[f].alias(f) for f in champs], *[F.coalesce(F.col(f"{name}_{snake(c)}"), F.array().cast(met.schema[f"{name}_{snake(c)}"].dataType)).alias(snake(c)) for c in read_of(kind, fields)[1]])
        return F.when(F.col(f"{name}_champs").isNotNull(), row).alias(name)

    return met.select("dossier_id", "types", "documents", *[c for c in ("factures",) if c in met.columns], *[whole(k) for k in others])


def engagement_rows(docs: DataFrame) -> DataFrame:
    """One row for each engagement reference among ``docs`` (document_id, type, upload, data): its type is the first document's, and each field the last value that could be read.

    Documents without a reference, or of another type, make none. Fields of other types are null.
    """
    fields = ENGAGEMENT | {n: h for of in ENGAGEMENT_OF.values() for n, h in of.items()}
    json = F.from_json("data", _schema({"reference": "text"} | fields))
    rows = docs.filter(F.col("type").isin(*ENGAGEMENT_OF)).withColumn("__json", json)
    rows = rows.select("type", F.struct("upload", "document_id").alias("ordre"), F.trim(_string(F.col("__json.reference"))).alias("reference"), *_scalars(fields, lambda n: F.col("__json")[n])).filter("reference <> ''")
    last = [F.max_by(snake(n), F.when(F.col(snake(n)).isNotNull(), F.col("ordre"))).alias(snake(n)) for n in fields]
    met = rows.groupBy("reference").agg(F.min_by("type", "ordre").alias("type"), F.max("ordre.upload").alias("modifie"), *last)
    mine = {snake(n): kind for kind, of in ENGAGEMENT_OF.items() for n in of}
    return met.select("reference", "type", "modifie", *[(F.when(F.col("type") == mine[c], F.col(c)) if c in mine else F.col(c)).alias(c) for c in map(snake, fields)])


def _text(name: str) -> Column:
    return F.nullif(F.trim(quality.field(F.col("data"), name)), F.lit(""))


def _amount(name: str) -> Column:
    return scalars.parse_amount_strict(quality.field(F.col("data"), name))


def invoices(docs: DataFrame) -> DataFrame:
    """Typed rows of the invoices among ``docs`` (document_id, type, and data as a map of its fields); what cannot be read is null."""
    return docs.filter("type = 'FACTURE'").select(
        "document_id", _text("numeroFacture").alias("numero"), _text("fournisseur").alias("fournisseur"), scalars.normalize_ice(_text("ice")).alias("ice"), scalars.parse_date(_text("dateFacture")).alias("jour"),
        _amount("montantHT").alias("ht"), _amount("montantTVA").alias("tva"), _amount("montantTTC").alias("ttc"),
    )


def with_cached_text(uploads: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """Uploads (batch or stream, with sha256) and the text that the cache holds for this content in this version, if any."""
    known = cache.filter(F.col("version") == version).groupBy("sha256").agg(F.first("texte").alias("texte"))
    return uploads.join(known, "sha256", "left").withColumn("en_cache", F.col("texte").isNotNull())


def cache_rows(recognised: DataFrame, version: int) -> DataFrame:
    """Rows to add to the cache: one for each content."""
    return recognised.filter("texte is not null").groupBy("sha256").agg(F.min("texte").alias("texte")).withColumn("version", F.lit(version))


def fold_cache(cache: DataFrame, uploads: DataFrame, version: int) -> DataFrame:
    """The cache (sha256, version, texte, hits, dernier) after ``uploads`` (sha256, ts, texte: what recognition gives) in one version.

    An entry of this version is hit by each upload of its content; otherwise the first upload is recognised and stored in its place,
    and the later ones hit it. Blank texts are never stored, so they hit nothing. Uploads of one content are summed before they meet its entry.
    """
    readable = F.coalesce(F.trim("texte") != "", F.lit(False))
    met = uploads.groupBy("sha256").agg(F.count(F.lit(1)).alias("__n"), F.max("ts").alias("__ts"), F.min_by("texte", F.when(readable, F.col("ts"))).alias("__texte"))
    out = cache.join(met, "sha256", "full_outer")
    same, seen = F.coalesce(F.col("version") == version, F.lit(False)), F.col("__n").isNotNull()
    stored = seen & ~same & F.coalesce(F.trim("__texte") != "", F.lit(False))
    hits = F.when(stored, F.col("__n") - 1).when(seen & same, F.col("hits") + F.col("__n")).otherwise(F.col("hits"))
    return out.filter(F.col("version").isNotNull() | stored).select(
        "sha256", F.when(stored, version).otherwise(F.col("version")).alias("version"), F.when(stored, F.col("__texte")).otherwise(F.col("texte")).alias("texte"), hits.cast("bigint").alias("hits"),
        F.when(stored | (seen & same), F.col("__ts")).otherwise(F.col("dernier")).alias("dernier"),
    )
