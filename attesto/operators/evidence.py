"""Evidence of verdicts: which field of which document says what, and the documents that a rule is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesto.operators.verdicts import emit

#: Document types by the prefix of their context columns.
DOCUMENTS = {
    "f": "FACTURE", "bc": "BON_COMMANDE", "ct": "CONTRAT_AVENANT", "op": "ORDRE_PAIEMENT", "pv": "PV_RECEPTION", "arf": "ATTESTATION_FISCALE", "ck": "CHECKLIST_AUTOCONTROLE", "tc": "TABLEAU_CONTROLE",
}
_START, _REFERENCE = "coalesce(bc_date, ct_date)", "coalesce(bc_reference, ct_reference)"
#: Fixed values: (role, field, document, value as an expression over the context) of each rule. A role with ``?`` is left out where the value is null.
EVIDENCE = {
    "R01": [("trouve", "montantTTC", "f", "f_ttc"), ("attendu", "montantTTC", "bc", "bc_ttc")], "R02": [("trouve", "montantHT", "f", "f_ht"), ("attendu", "montantHT", "bc", "bc_ht")],
    "R03": [("trouve", "montantTVA", "f", "f_tva"), ("attendu", "montantTVA", "bc", "bc_tva")], "R03b": [("trouve", "tauxTVA", "f", "f_taux"), ("attendu", "tauxTVA", "bc", "bc_taux")], "R30": [("source", "tauxTVA", "f", "f_taux")],
    "R04": [("trouve", "montantOperation", "op", "op_montant"), ("attendu", "montantTTC", "f", "f_ttc")], "R05": [("trouve", "montantOperation", "op", "op_montant"), ("source", "montantTTC", "f", "f_ttc")],
    "R07": [("attendu", "numeroFacture", "f", "f_numero"), ("trouve", "referenceFacture", "op", "op_reference_facture")], "R08": [("attendu", "reference", "bc|ct", _REFERENCE), ("trouve", "referenceBcOuContrat", "op", "op_reference_bc")],
    "R09": [("source", "ice", "f", "f_ice"), ("source", "ice", "arf", "arf_ice"), ("source?", "ice", "bc", "bc_ice"), ("source?", "ice", "op", "op_ice")], "R09b": [("source?", "ice", "f", "f_ice"), ("source?", "ice", "arf", "arf_ice")],
    "R10": [("source", "identifiantFiscal", "f", "f_id_fiscal"), ("source", "identifiantFiscal", "arf", "arf_id_fiscal")], "R11": [("source?", "rib", "f", "f_rib"), ("trouve?", "rib", "op", "op_rib")],
    "R14b": [
        ("source", "fournisseur", "f", "f_fournisseur"), ("source", "raisonSociale", "arf", "arf_fournisseur"), ("source?", "ice", "f", "f_ice"), ("source?", "ice", "arf", "arf_ice"), ("source?", "identifiantFiscal", "f", "f_id_fiscal"),
        ("source?", "identifiantFiscal", "arf", "arf_id_fiscal"),
    ],
    "R16": [("source", "montantHT", "f", "f_ht"), ("source", "montantTVA", "f", "f_tva"), ("calcule", "montantAttendu", "", "f_ht + f_tva"), ("trouve", "montantTTC", "f", "f_ttc")], "R16c": [("attendu", "montantHT", "f", "f_ht")],
    "R17a": [("attendu", "dateBc", "bc|ct", _START), ("trouve", "dateFacture", "f", "f_date")], "R17b": [("attendu", "dateFacture", "f", "f_date"), ("trouve", "dateEmission", "op", "op_date")],
    "R18": [("source", "dateEdition", "arf", "arf_date"), ("calcule", "dateReference", "op", "coalesce(op_date, DATE '1999-01-01')")], "R22": [("trouve", "dateEmission", "op", "op_date"), ("attendu", "dateReception", "pv", "pv_date")],
    "R19": [("attendu", "codeVerification", "arf", "arf_code"), ("source", "qrPayload", "arf", "coalesce(arf_qr, '(absent)')")], "R23": [("source", "estEnRegle", "arf", "arf_en_regle")],
    "R25": [("source", "dateReception", "pv", "pv_date"), ("trouve", "dateEmission", "op", "op_date")], "R26": [("source", "modePaiement", "op", "op_mode"), ("source?", "montantBrut", "op", "op_brut"), ("source?", "montantTTC", "f", "f_ttc"), ("source?", "montantOperation", "op", "op_montant")],
    "R27": [("source", "devise", "f", "f_devise")], "R12.01": [("trouve?", "montantTTC", "f", "f_ttc"), ("attendu?", "montantTTC", "bc", "bc_ttc"), ("source?", "referenceContrat", "ct", "ct_reference")],
    "R12.02": [("source?", "montantHT", "f", "f_ht"), ("source?", "montantTVA", "f", "f_tva"), ("trouve?", "montantTTC", "f", "f_ttc")],
}
_F, _BC, _OP, _CT, _ARF = "FACTURE", "BON_COMMANDE", "ORDRE_PAIEMENT", "CONTRAT_AVENANT", "ATTESTATION_FISCALE"
#: The types of document that a rule is about.
RULE_TYPES = {
    "R01": [_F, _BC], "R02": [_F, _BC], "R03": [_F, _BC], "R03b": [_F, _BC], "R04": [_F, _OP], "R05": [_F, _OP], "R07": [_F, _OP], "R08": [_BC, _CT, _OP], "R09": [_F, _ARF], "R10": [_F, _ARF], "R15": [_F, _CT, "PV_RECEPTION"],
    "R16": [_F], "R16b": [_F], "R16c": [_F], "R01f": [_F, _BC], "R01g": [_F, _BC, _CT], "R14": [_F, _BC, _OP, _ARF], "R14b": [_F, _ARF], "R17": [_F, _BC, _OP], "R18": [_ARF], "R19": [_ARF], "R20": [],
}


def _piece(role: str, name: str, document: str, value: str) -> Column:
    of = document.split("|")
    own, kind = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    for prefix in reversed([p for p in of if p]):
        there = F.col(f"doc_{prefix}").isNotNull()
        own, kind = F.when(there, F.col(f"doc_{prefix}")).otherwise(own), F.when(there, DOCUMENTS[prefix]).otherwise(kind)
    said = F.nullif(F.expr(value).cast("string"), F.lit(""))
    piece = F.struct(F.lit(role.rstrip("?")).alias("role"), F.lit(name).alias("champ"), own.alias("document_id"), kind.alias("type_document"), said.alias("valeur"))
    return F.when(said.isNotNull(), piece) if role.endswith("?") else piece


def emit_with_evidence(context: DataFrame, rules: list[Column], key: str = "dossier_id", codes: list[str] | None = None, give: tuple[str, ...] = ("preuves", "documents")) -> DataFrame:
    """The verdicts of ``emit`` with ``preuves`` (role, champ, document_id, type_document, valeur) and ``documents``, the ids of the documents that the rule is about, or with one of these.

    The evidence is read from the same context row as the verdict, in the same pass. ``codes``: the rules that can be there, where these are known.
    """
    rows = emit(context, rules, key, keep=[c for c in context.columns if c != key])
    nothing = F.array().cast("array<struct<role:string,champ:string,document_id:bigint,type_document:string,valeur:string>>")
    found = F
    for rule, pieces in EVIDENCE.items() if "preuves" in give else ():
        if codes is not None and rule not in codes:
            continue
        found = found.when(F.col("regle") == rule, F.array_compact(F.array(*[_piece(*p) for p in pieces])))
    types = F.create_map(*[x for rule, kinds in RULE_TYPES.items() for x in (F.lit(rule), F.array(*map(F.lit, kinds)).cast("array<string>"))])
    about = F.transform(F.filter("pieces", lambda d: F.array_contains(F.element_at(types, F.col("regle")), d["type"])), lambda d: d["document_id"])
    verdict = [c for c in rows.columns if c not in context.columns]
    given = {"preuves": lambda: nothing if found is F else found.otherwise(nothing), "documents": lambda: F.when(F.size(about) > 0, about)}
    return rows.select(key, *verdict, *[given[name]().alias(name) for name in give])
