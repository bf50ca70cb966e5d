"""The words by which prose, front matter and tables state relations and what became of items."""

from __future__ import annotations

#: Front-matter key: (relation, whether it points back).
RELATION_KEYS = {
    "supersedes": ("supersedes", False), "supercedes": ("supersedes", False), "replaces": ("supersedes", False), "obsoletes": ("supersedes", False), "deprecates": ("supersedes", False),
    "superseded-by": ("supersedes", True), "superceded-by": ("supersedes", True), "replaced-by": ("supersedes", True), "obsoleted-by": ("supersedes", True), "deprecated-by": ("supersedes", True), "rolled-into": ("supersedes", True),
    "amends": ("amends", False), "extends": ("amends", False), "refines": ("amends", False), "clarifies": ("amends", False), "revises": ("amends", False),
    "amended-by": ("amends", True), "extended-by": ("amends", True), "refined-by": ("amends", True), "clarified-by": ("amends", True), "revised-by": ("amends", True),
    "depends-on": ("depends-on", False), "dependent-on": ("depends-on", False), "dependencies": ("depends-on", False), "requires": ("depends-on", False), "builds-on": ("depends-on", False), "relies-on": ("depends-on", False),
    "depended-on-by": ("depends-on", True), "required-by": ("depends-on", True), "dependents": ("depends-on", True), "assumes": ("assumes", False), "assumed-by": ("assumes", True),
    "blocked-by": ("blocked-by", False), "blocked-on": ("blocked-by", False), "waiting-on": ("blocked-by", False), "waiting-for": ("blocked-by", False), "gated-on": ("blocked-by", False), "gated-by": ("blocked-by", False), "blocks": ("blocked-by", True),
    "delegates-to": ("delegates-to", False), "delegated-to": ("delegates-to", False), "deferred-to": ("delegates-to", False), "tracked-in": ("delegates-to", False), "tracked-by": ("delegates-to", False), "continued-in": ("delegates-to", False), "delegated-from": ("delegates-to", True),
    "related": ("relates-to", False), "relates-to": ("relates-to", False), "related-to": ("relates-to", False), "see-also": ("relates-to", False),
    "references": ("references", False), "reference": ("references", False), "refs": ("references", False), "referenced-by": ("references", True),
}

#: (relation, whether it points back, phrases that govern a citation).
VERBS = (
    ("supersedes", True, ("superseded by", "superceded by", "replaced by", "obsoleted by", "deprecated by", "rolled into")),
    ("supersedes", False, ("supersedes", "supercedes", "replaces", "obsoletes", "deprecates")),
    ("amends", True, ("amended by", "refined by", "clarified by", "revised by")),
    ("amends", False, ("amends", "refines", "clarifies", "revises")),
    ("delegates-to", False, (
        "delegated to", "delegate to", "deferred to", "defer to", "moved to", "move to", "tracked in", "tracked by", "handed off to", "handed to", "hand off to", "follow up in", "follow-up in", "followup in",
        "continued in", "continues in", "punted to", "left to", "belongs in", "owned by", "will be decided in", "will be resolved in", "will be handled in", "will be handled by", "will be answered in",
        "to be decided in", "to be resolved in", "to be handled in", "to be answered in",
    )),
    ("blocked-by", False, ("blocked by", "blocked on", "waiting on", "waiting for", "gated on", "gated by", "unblocked by")),
    ("blocked-by", True, ("blocks", "blocking")),
    ("depends-on", False, ("depends on", "depend on", "dependent on", "requires", "builds on", "built on", "relies on")),
    ("depends-on", True, ("depended on by",)),
    ("assumes", False, (
        "assumes", "assuming", "on the assumption of", "as decided in", "as established in", "as established by", "as stated in", "as specified in", "as required by", "as mandated by", "in accordance with",
        "constrained by", "mandated by", "governed by", "predicated on", "rests on", "follows from", "justified by", "imposed by", "required by", "dictated by", "determined by", "limited by", "capped by", "bounded by",
        "defined by", "defined in", "specified by", "set by", "per", "because", "since",
    )),
)
NEGATIONS = ("no", "not", "no-one", "nobody", "none", "never", "neither", "nor", "nothing", "without")
BETWEEN_NEGATION_AND_VERB = ("be", "been", "being", "is", "are", "was", "were", "yet", "longer", "ever", "even", "currently", "actually", "really", "necessarily", "always")
VERB_WINDOW = 40

WEAK_SECTIONS = (
    "see also", "references", "reference", "related", "related work", "related decisions", "related documents", "links", "further reading", "prior art", "history", "changelog", "change log", "revision history",
    "bibliography", "sources", "appendix", "more information", "resources", "index",
)
OBLIGATION_SECTIONS = (
    "open questions", "open question", "unresolved questions", "unanswered questions", "questions", "open issues", "action items", "actions", "todo", "to do", "to-do", "todos", "next steps", "follow ups", "follow-ups",
    "followups", "follow up", "follow-up", "unresolved", "outstanding", "outstanding questions", "tasks", "task list", "work items", "remaining work", "decisions needed", "blockers", "parking lot", "future work", "deferred",
)
NOT_A_FAMILY = (
    "ver", "version", "pp", "fig", "figure", "table", "tbl", "section", "sect", "sec", "step", "item", "no", "num", "line", "ln", "col", "port", "pr", "issue", "gh", "utf", "ascii", "sha", "md", "http", "https", "ipv", "tls", "ssl",
    "es", "ecma", "p99", "base", "sql", "ipv4", "ipv6", "arm", "x86", "win", "node", "python", "java", "go", "cpp",
)

SIGNAL_PRIORITY = {"directive": 5, "marker": 4, "strikethrough": 3, "checkbox": 2, "section": 1, "default": 0}
CHECKBOXES = {" ": "unresolved", "x": "satisfied", "X": "satisfied", "+": "satisfied", "~": "narrowed", "/": "narrowed", "-": "rejected", "?": "unresolved", "!": "unresolved", "*": "unresolved"}
MARKERS = {
    "satisfied": ("resolved", "answered", "decided", "settled", "done", "complete", "completed", "closed", "fixed", "shipped", "addressed", "implemented", "solved", "confirmed"),
    "narrowed": ("partially resolved", "partially answered", "partially done", "partly resolved", "narrowed", "narrowed to", "scoped down", "reduced scope", "reduced to", "partial", "in progress", "remaining", "split"),
    "delegated": ("delegated", "delegated to", "moved to", "tracked in", "tracked by", "handed off", "handed off to", "handed to", "deferred to", "follow up in", "follow-up in", "followup in", "continued in", "owned by"),
    "accepted-debt": ("accepted debt", "accepted as debt", "accepted risk", "known limitation", "known issue", "known gap", "technical debt", "tech debt", "wontfix", "won't fix", "will not fix", "by design", "tolerated", "living with it"),
    "rejected": ("rejected", "declined", "dropped", "not doing", "will not do", "abandoned", "cancelled", "canceled", "withdrawn"),
    "obviated": ("no longer applicable", "no longer relevant", "no longer needed", "overtaken by events", "premise invalid", "obviated", "obsolete", "not applicable", "moot", "void", "n/a", "obe"),
    "unresolved": ("unresolved", "still open", "open question", "tbd", "undecided", "reopened"),
}
STATE_ALIASES = {
    "open": "unresolved", "unresolved": "unresolved", "todo": "unresolved", "narrowed": "narrowed", "partial": "narrowed", "delegated": "delegated", "satisfied": "satisfied", "resolved": "satisfied", "done": "satisfied",
    "closed": "satisfied", "accepted-debt": "accepted-debt", "debt": "accepted-debt", "wontfix": "accepted-debt", "rejected": "rejected", "declined": "rejected", "obviated": "obviated", "moot": "obviated",
}

ID_COLUMNS = ("id", "ids", "ref", "reference", "key", "no", "number", "#", "adr", "rfc", "kep", "oi", "decision", "spec", "specification")
STATUS_COLUMNS = ("status", "state", "stage", "lifecycle", "phase")
TITLE_COLUMNS = ("title", "name", "summary", "description", "subject", "decision", "topic")
RELATION_COLUMNS = {
    "depends on": ("depends-on", False), "depends-on": ("depends-on", False), "dependencies": ("depends-on", False), "requires": ("depends-on", False), "supersedes": ("supersedes", False), "replaces": ("supersedes", False),
    "superseded by": ("supersedes", True), "replaced by": ("supersedes", True), "blocked by": ("blocked-by", False), "blocked on": ("blocked-by", False), "blocks": ("blocked-by", True), "amends": ("amends", False),
    "extends": ("amends", False), "assumes": ("assumes", False), "delegates to": ("delegates-to", False), "delegated to": ("delegates-to", False), "tracked in": ("delegates-to", False),
    "related": ("relates-to", False), "related to": ("relates-to", False), "see also": ("relates-to", False), "references": ("references", False),
}
DIRECTIVES = ("spec-node", "spec-item", "spec-edge", "spec-ignore")
