"""Word lists. Results depend on them word for word."""

STOPWORDS = (
    "a an the and or but if then than so to of in on for with as at by from into that this these those is are was were be being been it its they their them "
    "he she his her you your we our i me my not no yes very more most less least can could should would may might must also just really quite about over under "
    "between within without across through during before after while where when what which who whom because there here such some any each both either neither "
    "many much few one two three etc"
).split()
PRAISE = "strong|beautiful|compelling|excellent|elegant|poetic|successful|impressive|thoughtful|refined|coherent|clear|innovative|evocative|powerful|serene|confident|wonderful|works well|stands out".split("|")
CRITIQUE = "unclear|confusing|weak|lacking|absence|missing|difficult|problem|issue|fails|does not|doesn't|too|crammed|overly|inconsistent|unresolved|needs|could be improved|not enough".split("|")
SUGGESTION = "could|would|should|if|it would be|consider|needs to|need to|would have".split("|")
STANCES = ["praise", "critique", "suggestion", "neutral"]
NAME_HEADERS = "selected jurors|jury|comments|competition".split("|")
STEM_SUFFIXES = "ation ition tion sion ingly edly ing ed est er ly es s".split()
FILLER_WORDS = "areas project design spaces brief proposal".split()
NON_NOUN_STARTS = "addressing shows move goes tells appearing seems is are about".split()
UNATTRIBUTED = "Unattributed"
