"""A small lexicon for web prose: notices, contact data and insults in four languages."""

from __future__ import annotations

from ..operators.markers import Cue, MarkerSpec, Ontology

MARKERS = (
    MarkerSpec("license_notice", ("licen[sc]ed under", "released under"), ("version 3", "not licen[sc]ed")),
    MarkerSpec("phone_number", (r"\+1 \(\d{3}\) 555-\d{4}",)),
    MarkerSpec("mail_address", (r"[a-z0-9.]+@[a-z0-9]+\.[a-z.]+",)),
    MarkerSpec(
        "insult",
        ("idiot", "clown", "loser", "trash"),
        ("not the", " no clown"),
        severity=(Cue("idiot", "severe", 3), Cue("trash", "moderate", 2)),
        graded=True,
    ),
    MarkerSpec("negation", ("nicht", " pas "), (" ne .* pas ",)),
    MarkerSpec("symbol_noise", (r"[#%$*&]{3}",)),
)

ONTOLOGY = Ontology(
    version="web-lexicon-1",
    markers=MARKERS,
    remote_cues=(" was ", " war ", "était", " fue "),
    current_cues=(" is ", " ist ", " est ", " es "),
    severity_cues=(Cue(r"555|@", "moderate", 2), Cue("license", "mild", 1)),
    uncertain_cues=(" or ", " oder ", " ou "),
    third_party_cues=(" he ", " er ", " lui ", " la "),
)

# A second, narrower lexicon: the comparison extractor.
NARROW = Ontology(
    version="web-lexicon-0",
    markers=(
        MarkerSpec("license_notice", ("released under",)),
        MarkerSpec("phone_number", (r"\+1 \(",)),
        MarkerSpec("mail_address", ("@mail",)),
        MarkerSpec("insult", ("idiot", "clown"), graded=True),
        MarkerSpec("negation", ("nicht",), (" pas ",)),
        MarkerSpec("symbol_noise", ("###", "%%%")),
    ),
    remote_cues=(" was ", " war "),
    current_cues=(" is ", " ist "),
    severity_cues=(),
    uncertain_cues=(" or ",),
    third_party_cues=(" he ",),
)
