"""Fixed values of the record model: domains, thresholds, rates."""

PROVENANCES = ("computed", "extracted", "manual", "external")
TRUTH_POLICIES = ("trusted", "extracted", "unknown")
LABELS = ("solved", "band", "misdirection", "collapse", "drop")
UNSOLVABLE = ("drop", "collapse", "misdirection")
ROLLOUT_VERDICTS = ("correct", "wrong", "degenerate")
GATE_STATUSES = ("well_posed", "ill_posed", "defer", "error")
GATE_SCORES = {"well_posed": 1.0, "ill_posed": 0.0, "defer": 0.5, "error": 0.0}
PUBLICATION_STATUSES = ("published", "unpublished", "defer", "error", "discarded")
AGREEMENTS = ("unanimous_pass", "unanimous_fail", "unanimous_defer", "split", "has_missing")
POLICIES = ("intersect", "union", "majority")
WEIGHT_POLICIES = ("cap1", "capk", "inverse")
EVAL_SLICES = ("eval_band", "anchor_solved", "anchor_fail")
LEDGER_VERDICTS = ("new", "replay", "uid_conflict", "stmt_conflict", "warn")
BATCH_STATES = ("SLICED", "MOUNTED", "CASCADE_DONE", "PASSK_DONE", "READY")
FROZEN = "FROZEN"
BAND_LO, BAND_HI = 0.125, 0.75
MISDIRECTION_SHARE, DEGENERATE_SHARE = 0.5, 0.5
SLICE_SIZE, ROLLOUTS, REGEN = 250, 8, 6
EGRESS_USD_PER_GB = 0.09
Z_95 = 1.959963984540054
FUZZY_TIERS = ((0.90, "high"), (0.75, "medium"), (0.60, "low"))
ADJACENCY_GAP, OMITTED_CHARS, STUB_CHARS, RESOLVED_CHARS = 2000, 40, 200, 600
#: Markers of macro residue in an answer (fixed values, matched case-sensitively anywhere).
JUNK_MARKERS = (
    "mathrm", "mathbb", "mathcal", "mathbf", "mathsf", "operatorname", "Bigl", "Bigr", "bigl", "bigr", "widetilde", "widehat",
    "cdots", "ldots", "efsub", "displaystyle", "text", "boldsymbol", "mathfrak", "mathscr",
)
