"""Word lists and codes that must equal the published ones for right results."""

# Hedge words.
HEDGES = """
may might could would can
often usually typically generally sometimes frequently rarely
possibly probably perhaps seemingly apparently
suggest suggests suggesting suggested
seem seems seemed appear appears appeared
likely unlikely potential potentially
generally broadly roughly approximately
""".split()
HEDGES = list(dict.fromkeys(HEDGES))

# Labels of texts without one leading area, and the stratified sample's quotas.
GENERAL = "General medicine (no clear lexical match)"
MIXED = "Multi-specialty stem (tied lexical scores)"
QUOTAS = {
    "General medicine (no clear lexical match)": 18,
    "Obstetrics & gynaecology": 6,
    "Nephrology & urology": 6,
    "Respiratory medicine": 6,
    "Cardiovascular medicine": 4,
}

# Ontology release codes.
IS_A = "116680003"
ROOT = "138875005"
FSN = "900000000000003001"
SYNONYM = "900000000000013009"

# Top-level hierarchies.
TOP_LEVEL = [
    ("404684003", "Clinical finding"),
    ("71388002", "Procedure"),
    ("123037004", "Body structure"),
    ("410607006", "Organism"),
    ("105590001", "Substance"),
    ("363787002", "Observable entity"),
    ("272379006", "Event"),
    ("243796009", "Situation with explicit context"),
    ("48176007", "Social context"),
    ("308916002", "Environment or geographical location"),
    ("786210002", "Physical object"),
    ("260787004", "Physical force"),
    ("49755003", "Morphologically abnormal structure"),
    ("123038009", "Specimen"),
    ("734139008", "Treatment"),
    ("370115009", "Special concept"),
    ("419891003", "Record artifact"),
    ("373873005", "Pharmaceutical / biologic product"),
]

# What stands for the excerpts of a pair without a shared case, the parts of a panel's title, a judge's fields.
NO_SHARED_CASE = "(no single shared case file; stems split — excerpts omitted)"
PANEL_TITLE = (': "', '" (human) vs "', '" (model)')
JUDGEMENT = "coherence_score int, ontology_fit_score int, narrative_to_graph_alignment string, suspicious_mappings array<struct<entity_hint:string,concept_label_or_id:string,issue:string>>, disconnected_subthemes array<string>, human_vs_model_packaging string, verdict string, rationale string"

#: English function words that frequency lists leave out; a parameter of the operators.
STOP_WORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by
can did do does doing down during each few for from further had has have having he her here hers him his how i if in into is
it its just me more most my no nor not now of off on once only or other our out over own same she so some such than that
the their them then there these they this those through to too under until up very was we were what when where which while who
whom why will with you your
""".split()
