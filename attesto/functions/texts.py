"""Column functions on recognised text: quality scores, normalisation, document types, pseudonyms and grounding."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words whose presence speaks for a well recognised document.
KEYWORDS = (
    "facture", "total", "tva", "montant", "ice", "ht", "ttc", "fournisseur", "client", "date", "rib", "banque", "paiement", "commande", "contrat", "avenant", "prestation", "reception",
    "attestation", "fiscale", "identifiant", "patente", "cnss", "dirham", "dh", "mad", "net", "brut", "retenue", "bon", "ordre", "controle", "autocontrole", "checklist",
    "signature", "visa", "objet", "reference", "numero",
)
#: Patterns of personal data, in the order in which they are replaced.
PERSONAL = {
    "EMAIL": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "PHONE": r"(?<![\d])(?:\+212[-.\s]?|0)[567](?:[-.\s]?\d){8}(?![\d])",
    "PERSON": r"\b(?:M\.|Mme\.?|Mlle\.?|Monsieur|Madame|Mademoiselle)\s+[A-ZÉÈÀÂÎÔÛÇ][a-zéèêàâîïôûçA-ZÉÈÀÂÎÔÛÇ'\-]+(?:\s+[A-ZÉÈÀÂÎÔÛÇ][a-zéèêàâîïôûçA-ZÉÈÀÂÎÔÛÇ'\-]+){0,3}",
}


def _lines(text: Column) -> Column:
    return F.split(text, "\r\n|\n|\r")


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def _words(text: Column, least: int) -> Column:
    return _count(F.split(text, r"\s+"), lambda w: F.length(w) >= least)


def _noise(text: Column) -> Column:
    return _count(_lines(text), lambda x: F.length(F.trim(x)).between(1, 2))


def is_table_row(line: Column) -> Column:
    """A line of a Markdown table: three bars at least."""
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 3


def recognition_score(text: Column) -> Column:
    """Words, decimal amounts, dates, headings and table rows, less very short lines; 0 for blank text."""
    amounts, dates = F.regexp_count(text, F.lit(r"\d+[.,]\d{2}")), F.regexp_count(text, F.lit(r"\b(\d{4}-\d{2}-\d{2}|\d{2}[/-]\d{2}[/-]\d{4})\b"))
    heads = _count(_lines(text), lambda x: F.ltrim(x).startswith("#"))
    score = _words(text, 2) + 10 * amounts + 5 * dates + 5 * heads + 15 * _count(_lines(text), is_table_row) - 5 * _noise(text)
    return F.when(F.coalesce(F.trim(text) == "", F.lit(True)), 0).otherwise(score)


def scan_score(text: Column) -> Column:
    """The score of a scan's candidates: words, numbers, amounts, financial words and labelled lines, less very short lines."""
    lower = F.lower(text)
    found = sum((F.when(F.contains(lower, F.lit(w)), 8).otherwise(0) for w in KEYWORDS), F.lit(0))
    labelled = _count(_lines(text), lambda x: F.contains(x, F.lit(":")) & (F.length(x) > 10))
    score = 2 * _words(text, 3) + 5 * F.regexp_count(text, F.lit(r"\d{3,}")) + 8 * F.regexp_count(text, F.lit(r"\d+[.,]\d{2}")) + found + 3 * labelled - 3 * _noise(text)
    return F.when(F.coalesce(F.trim(text) == "", F.lit(True)), 0).otherwise(score)


def text_confidence(words: Column) -> Column:
    """By density: 300 words are certain, 0.05 at least."""
    return F.when(words <= 0, 0.05).otherwise(F.least(F.greatest(words / 300, F.lit(0.05)), F.lit(1.0)))


def digit_confusions(text: Column) -> Column:
    """Letters that stand for digits: O and o for 0, l and I for 1."""
    return F.translate(text, "OolI", "0011")


def digits_only(text: Column) -> Column:
    return F.regexp_replace(digit_confusions(text), "[^0-9]", "")


def normalize_text(text: Column) -> Column:
    """What native expressions can mend: line ends, blank lines, labels, Arabic letters, control characters, double spaces."""
    steps = [
        ("\r\n", "\n"), ("\r", "\n"), ("\n{3,}", "\n\n"), (r"(?i)\bFactura\b", "Facture"), (r"\bTVA\b", "T.V.A."), (r"(?i)\bl\.C\.E", "I.C.E"), (r"\bRlB\b", "RIB"), ("ـ{2,}", "ـ"),
        ("[آأإ]", "ا"), ("[ً-ٰٟ]", ""), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F​‌‍﻿]", ""), (r"(?<=\S) {2,}(?=\S)", " "),
    ]
    for pattern, put in steps:
        text = F.regexp_replace(text, pattern, put)
    return F.trim(text)


AFTER_LABEL = (r"(?i)(I\.?C\.?E\.?\s*[:.]?\s*)([0-9OolI]{13,17})", r"(?i)(I\.?F\.?\s*[:.]?\s*)([0-9OolI]{6,10})", r"(?i)(R\.?I\.?B\.?\s*[:.]?\s*)([0-9OolI\s]{24,35})")
AMOUNT_AFTER_LABEL = r"(?i)((?:HT|TTC|TVA|Total|Montant|Net|Sous.?total|Remise|Base)\s*[:.]?\s*)([\d\s]+[.,]\s*\d{1,2})"


def _mend_numbers(texts: pd.Series) -> pd.Series:
    confused = str.maketrans("OolI", "0011")
    texts = texts.str.replace(AMOUNT_AFTER_LABEL, lambda m: m[1] + re.sub(r"\s+", "", m[2]), regex=True)
    for pattern in AFTER_LABEL:
        texts = texts.str.replace(pattern, lambda m: m[1] + m[2].translate(confused), regex=True)
    return texts


def mend_numbers(texts: Column) -> Column:
    """Digits after labels: blanks inside amounts go, confused letters become digits; rewrites inside a match need Python."""
    return F.pandas_udf(_mend_numbers, "string")(texts)


def document_type(text: Column) -> Column:
    """The first type whose words occur; the order decides. INCONNU where none does."""
    t = F.lower(text)
    has = lambda *words: sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0)) == len(words)
    any_of = lambda *words: sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0
    totals = any_of("ttc", "t.t.c", "tva", "t.v.a", "net a payer", "net à payer", "montant", "total ht")
    head = F.substring(t, 1, 600)
    return (
        F.when(has("ccf-en-04") | has("autocontr", "check"), "CHECKLIST_AUTOCONTROLE")
        .when(has("ccf-en-01") | has("liasse", "pieces") | has("check", "pieces justificatives"), "CHECKLIST_PIECES")
        .when(any_of("ordre de paiement", "synthese du controleur", "synthèse du contrôleur"), "ORDRE_PAIEMENT")
        .when(has("tableau de contr") & any_of("conforme", "observation"), "TABLEAU_CONTROLE")
        .when(any_of("procès-verbal", "proces-verbal", "pv de reception", "pv de réception"), "PV_RECEPTION")
        .when(any_of("regularite fiscale", "régularité fiscale", "direction generale des impots", "direction générale des impôts"), "ATTESTATION_FISCALE")
        .when(any_of("marche de travaux", "marche de fournitures", "marche de services", "ccag-t", "ccag-emo", "decret 2-12-349") | has("appel d'offres", "titulaire"), "MARCHE")
        .when(any_of("bon de commande cadre", "bc cadre", "marche a bons de commande") | has("bon de commande", "plafond", "validit"), "BON_COMMANDE_CADRE")
        .when(any_of("contrat de maintenance", "contrat d'entretien", "contrat d'abonnement", "contrat de prestations") | has("reconduction tacite", "contrat"), "CONTRAT_CADRE")
        .when(has("contrat") & any_of("avenant", "convention"), "CONTRAT_AVENANT")
        .when((F.contains(head, F.lit("facture")) | F.contains(head, F.lit("invoice"))) & totals, "FACTURE")
        .when(has("bon de commande") | text.rlike(r"(?i)cf\s*sie\s*\d+"), "BON_COMMANDE")
        .when(any_of("ouverture de compte", "formulaire fournisseur"), "FORMULAIRE_FOURNISSEUR")
        .when(has("facture") & totals, "FACTURE").otherwise("INCONNU")
    )


def resolved_type(keyword_type: Column, model_type: Column, confidence: Column) -> Column:
    """The keyword's type, else the model's where its confidence is 0.6 at least, else INCONNU."""
    return F.when(keyword_type != "INCONNU", keyword_type).when(confidence >= 0.6, F.coalesce(model_type, F.lit("INCONNU"))).otherwise("INCONNU")


def _pseudonymize(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        known: dict[str, str] = {}
        for kind, pattern in PERSONAL.items():
            count = 0

            def token(m, kind=kind):
                nonlocal count
                if m[0] not in known:
                    count += 1
                    known[m[0]] = f"[{kind}_{count}]"
                return known[m[0]]

            text = None if text is None else re.sub(pattern, token, text)
        out.append((text, {v: k for k, v in known.items()}))
    return pd.DataFrame(out, columns=["text", "mapping"])


def pseudonymize(texts: Column) -> Column:
    """Numbered tokens for e-mail addresses, phones and persons, the same value the same token; and token to value."""
    return F.pandas_udf(_pseudonymize, "text string, mapping map<string,string>")(texts)


def restore(text: Column, mapping: Column) -> Column:
    """The text with its tokens replaced by the values again."""
    return F.aggregate(F.map_entries(mapping), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def _first_json_object(texts: pd.Series) -> pd.Series:

    def find(text: str | None) -> str | None:
        start = -1 if text is None else text.find("{")
        depth, quoted, skip = 0, False, False
        for i in range(max(start, 0), 0 if start < 0 else len(text)):
            ch = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = ch == "\\", ch != '"'
            elif ch == '"':
                quoted = True
            else:
                depth += (ch == "{") - (ch == "}")
                if not depth:
                    return text[start : i + 1]
        return None

    return texts.map(find, na_action=None)


def first_json_object(texts: Column) -> Column:
    """The first balanced ``{...}``, strings and escapes respected; null if there is none."""
    return F.pandas_udf(_first_json_object, "string")(texts)


def _columns_to_markdown(texts: pd.Series) -> pd.Series:

    def table(block: list[list[str]]) -> list[str]:
        width = max(map(len, block))
        rows = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in block]
        return [rows[0], "|" + " --- |" * width, *rows[1:]]

    def convert(text: str | None) -> str | None:
        if text is None:
            return None
        out: list[str] = []
        block: list[list[str]] = []
        raw: list[str] = []
        for line in [*text.split("\n"), None]:
            cells = [] if line is None else [x.strip() for x in re.split(r" {2,}|\t+", line.strip()) if x.strip()]
            if block and (line is None or len(cells) < 2 or abs(len(cells) - len(block[0])) > 1):
                out += table(block) if len(block) > 1 else raw
                block, raw = [], []
            if line is not None and len(cells) > 1:
                block.append(cells)
                raw.append(line)
            elif line is not None:
                out.append(line)
        return "\n".join(out)

    return texts.map(convert, na_action=None)


def columns_to_markdown(texts: Column) -> Column:
    """Blocks of two lines or more with two columns or more (within one of the first line's) become Markdown tables."""
    return F.pandas_udf(_columns_to_markdown, "string")(texts)


def jaro_winkler(a: str, b: str) -> float:
    """Common letters within half the longer length, transpositions, and a bonus for four first letters in common."""
    if not a or not b:
        return 0.0
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    if not mine:
        return 0.0
    m = len(mine)
    swaps = sum(x != y for x, y in zip(mine, (ch for ch, t in zip(b, taken, strict=True) if t), strict=True)) / 2
    score = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return score + prefix * 0.1 * (1 - score)


def jaro_winkler_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``jaro_winkler`` of many pairs at once: one step for each letter of the longest name, over all pairs."""
    la, lb = np.char.str_len(a), np.char.str_len(b)
    wide, high = max(int(la.max(initial=0)), 1), max(int(lb.max(initial=0)), 1)
    x = a.astype(f"U{wide}").view(np.uint32).reshape(len(a), wide)
    y = b.astype(f"U{high}").view(np.uint32).reshape(len(b), high)
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    place, rows = np.arange(high)[None, :], np.arange(len(a))
    free, mine = place < lb[:, None], np.zeros(x.shape, dtype=bool)
    for i in range(wide):
        fits = free & (y == x[:, i : i + 1]) & (np.abs(place - i) <= window) & (i < la)[:, None]
        first, found = fits.argmax(axis=1), fits.any(axis=1)
        mine[:, i] = found
        free[rows[found], first[found]] = False
    theirs = (place < lb[:, None]) & ~free
    m = mine.sum(axis=1)
    left = np.take_along_axis(x, np.argsort(~mine, axis=1, kind="stable"), axis=1)
    right = np.take_along_axis(y, np.argsort(~theirs, axis=1, kind="stable"), axis=1)
    both = min(wide, high)
    swaps = ((left[:, :both] != right[:, :both]) & (np.arange(both)[None, :] < m[:, None])).sum(axis=1) / 2
    n, p, q = np.maximum(m, 1), np.maximum(la, 1), np.maximum(lb, 1)
    score = (m / p + m / q + (m - swaps) / n) / 3
    head = min(4, both)
    same = (x[:, :head] == y[:, :head]) & (np.arange(head)[None, :] < np.minimum(la, lb)[:, None])
    prefix = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    return np.where(m > 0, score + prefix * 0.1 * (1 - score), 0.0)


def jaro_winkler_all(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Similarity of each pair of two columns, 1 for equal names and 0 where one is empty or null."""
    left, right = a.fillna("").to_numpy(dtype=str), b.fillna("").to_numpy(dtype=str)
    out = [jaro_winkler_of(left[at : at + 4096], right[at : at + 4096]) for at in range(0, len(left), 4096)]
    return np.where((left == right) & (left != ""), 1.0, np.concatenate([*out, np.zeros(0)]))


def _name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(jaro_winkler_all(a, b))


def name_similarity(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity of two normalised names."""
    return F.pandas_udf(_name_similarity, "double")(a, b)


def grounded(value: Column, text: Column, kind: str, least: int) -> Column:
    """Whether an extracted identifier occurs in its text: its last ``least`` digits, or all of its letters and digits; shorter ones pass."""
    if kind == "DIGITS":
        digits = digits_only(value)
        return (F.length(digits) < least) | F.contains(digits_only(text), F.right(digits, F.lit(least)))
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return (F.length(bare(value)) < least) | F.contains(bare(text), bare(value))
