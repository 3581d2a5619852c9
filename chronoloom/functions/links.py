"""Subordination and aspect links within one sentence: trigger lexicons and automata over the nodes to the right or left.

A node is a chunk or a token outside chunks, with its features and those of its event.
The lexicons are small; more rows of (form, epos, direction, pattern, relation) can be given.
"""

from __future__ import annotations

from functools import cache

from .fsa import ANY, Automaton, compile_pattern, first_match

_NG, _VG = {"node": "ng"}, {"node": "vg"}
_EVENT = {"event": True}
_NOUN_EVENT = {"node": "ng", "event": True}
_ADVERB = [{"pos": "RB"}, "*"]
_TENSED = {"node": "vg", "event": True, "tense": ["PAST", "PRESENT", "FUTURE", "NONE"]}
_STOP = ("^", [".", ":", "?", "!"])

PATTERNS: dict[str, list] = {
    "to_clause": [*_ADVERB, {"node": "vg", "event": True, "infinitive": True}],
    "object_to_clause": [*_ADVERB, _NG, "+", {"node": "vg", "event": True, "infinitive": True}],
    "that_clause": ["(", {"text": ","}, "|", {"pos": ["RB", "IN"]}, "|", {"node": "ng"}, ")", "*", {"text": "that"}, "(", {"node": "ng"}, "|", {"pos": ["IN", "RB", "JJ", "CC", "PRP", "DT"]}, ")", "*", _TENSED],
    "bare_clause": [_ADVERB[0], "*", _NG, "+", "(", {"pos": ["IN", "CC", "RB"]}, "|", {"text": ","}, "|", _NG, ")", "*", _TENSED],
    "object_clause": [_NG, "+", "(", {"pos": "IN"}, _NG, ")", "*", {"node": "vg", "event": True}],
    "quoted_clause": [{"text": [",", ":"]}, "?", {"text": ["``", '"', "`"]}, "+", "(", {"node": "ng"}, "|", {"pos": ["IN", "RB", "JJ", "PRP"]}, ")", "*", _TENSED],
    "if_clause": [{"text": ["if", "whether"]}, "(", {"node": "ng"}, "|", {"pos": ["IN", "RB"]}, ")", "*", _TENSED],
    "question_clause": [{"pos": ["WRB", "WP", "WDT"]}, "(", {"node": "ng"}, "|", {"pos": ["IN", "RB"]}, ")", "*", _EVENT],
    "ing_clause": [*_ADVERB, {"node": "vg", "event": True, "tense": "PRESPART"}],
    "prep_ing_clause": [{"pos": "IN"}, {"node": "vg", "event": True, "tense": "PRESPART"}],
    "noun_object": [*_ADVERB, _NOUN_EVENT],
    "prep_noun": [{"pos": "IN"}, "(", _NG, {"pos": "IN"}, ")", "?", _NOUN_EVENT],
    "subject": [{"node": "vg"}, _NOUN_EVENT],
}

_FORWARD = {
    ("EVIDENTIAL", "object_clause that_clause"): "see hear watch",
    ("MODAL", "object_to_clause"): "call force enable",
    ("FACTIVE", "question_clause that_clause noun_object"): "investigate acknowledge discover",
    ("FACTIVE", "noun_object ing_clause"): "welcome provide",
    ("MODAL", "to_clause object_to_clause noun_object that_clause"): "want hope expect plan intend wish desire need agree promise propose offer order ask request persuade decide try attempt seek like love hate prepare vow swear threaten urge advise allow help call",
    ("FACTIVE", "ing_clause that_clause noun_object"): "regret know realize remember forget admit enjoy manage see watch hear notice celebrate cause",
    ("COUNTER_FACTIVE", "to_clause ing_clause prep_ing_clause noun_object prep_noun"): "decline refuse fail forget block prevent avoid reject cancel",
    ("EVIDENTIAL", "that_clause bare_clause quoted_clause"): "say report tell confirm announce state claim add explain declare note describe believe think suggest testify",
    ("NEG_EVIDENTIAL", "noun_object that_clause bare_clause ing_clause"): "deny doubt dispute",
    ("CONDITIONAL", "if_clause question_clause"): "ask wonder know decide",
}
_ALINK = {"INITIATES": "begin start initiate commence launch", "TERMINATES": "stop end halt quit cease abandon", "CULMINATES": "finish complete achieve", "CONTINUES": "continue keep maintain", "REINITIATES": "resume restart renew"}
_NOUNS = {("MODAL", "to_clause that_clause prep_ing_clause"): "agreement plan promise attempt decision proposal offer order hope effort request", ("EVIDENTIAL", "that_clause"): "report statement claim announcement", ("FACTIVE", "that_clause"): "fact"}
_ADJECTIVES = {("MODAL", "to_clause that_clause"): "able ready likely willing eager sure unable afraid possible", ("FACTIVE", "that_clause to_clause"): "happy sad glad sorry aware"}


@cache
def lexicon() -> tuple[tuple[str, str, str, str, str], ...]:
    """Rows (form, epos, kind, pattern, relation), in order of preference."""
    rows = []
    for table, epos in ((_FORWARD, "VERB"), (_NOUNS, "NOUN"), (_ADJECTIVES, "ADJECTIVE")):
        for (relation, patterns), forms in table.items():
            rows += [(f, epos, "SLINK", p, relation) for f in forms.split() for p in patterns.split()]
    for relation, forms in _ALINK.items():
        rows += [(f, "VERB", "ALINK", p, relation) for f in forms.split() for p in ("to_clause", "ing_clause", "noun_object", "prep_noun")]
    return tuple(rows)


@cache
def automaton(name: str) -> Automaton:
    return compile_pattern(PATTERNS[name])


@cache
def _by_form() -> dict[tuple[str, str, str], list[tuple[str, str]]]:
    out: dict[tuple[str, str, str], list[tuple[str, str]]] = {}
    for form, epos, kind, pattern, relation in lexicon():
        out.setdefault((form, epos, kind), []).append((pattern, relation))
    return out


def links(nodes: list[dict]) -> list[tuple[str, int, int, str, str]]:
    """(SLINK or ALINK, trigger node, target node, relation, pattern) of a sentence: for each event one ALINK at most, then one SLINK: forward, backward or reporting."""
    out = []
    for k, n in enumerate(nodes):
        if not n.get("event"):
            continue
        for kind in ("ALINK", "SLINK"):
            rows = _by_form().get((n["lemma"], n["epos"], kind), [])
            if rows:
                length, which = first_match([automaton(p) for p, _ in rows], nodes[k + 1 :])
                if length:
                    out.append((kind, k, k + length, rows[which][1], rows[which][0]))
                    continue
                if kind == "ALINK":
                    length, which = first_match([automaton("subject")], nodes[: k + 1][::-1])
                    if length:
                        out.append((kind, k, k - length + 1, rows[0][1], "subject"))
                        continue
            if kind == "SLINK" and rows and n.get("class") == "REPORTING" and nodes and nodes[0].get("text") in ("``", '"', "`"):
                close = next((j for j in range(1, k) if nodes[j].get("text") in ("''", '"') and any(0 <= i < len(nodes) and nodes[i].get("text") == "," for i in (j - 1, j + 1))), None)
                quoted = [j for j in range(1, close or 0) if nodes[j].get("event") and nodes[j]["node"] == "vg"]
                if quoted:
                    out.append((kind, k, quoted[-1], "EVIDENTIAL", "reporting"))
    return out


__all__ = ["ANY", "PATTERNS", "automaton", "lexicon", "links"]
