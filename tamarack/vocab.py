"""The vocabularies that give words, statuses and relations their meaning."""

from __future__ import annotations

#: Phases and their words, in order of precedence.
PHASE_WORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("retired", (
        "superseded", "superceded", "supersedes-by", "replaced", "deprecated", "obsolete", "obsoleted", "retired", "rejected", "declined",
        "withdrawn", "abandoned", "cancelled", "canceled", "dropped", "revoked", "reverted", "moved", "historical", "defunct",
        "inactive", "dead", "void", "closed", "postponed", "deferred", "not-planned", "wontfix",
    )),
    ("record", ("archived", "archive")),
    ("frozen", ("final", "finalised", "finalized", "frozen", "locked", "ratified", "immutable", "sealed", "standard", "published")),
    ("draft", ("provisionally-accepted",)),
    ("active", (
        "accepted", "active", "approved", "adopted", "agreed", "implementable", "implemented", "implementing", "current", "effective",
        "in-effect", "enforced", "stable", "merged", "released", "shipped", "live", "done", "complete", "completed",
        "signed-off", "committed",
    )),
    ("draft", (
        "draft", "drafting", "proposed", "proposal", "provisional", "prospective", "wip", "in-progress", "review", "reviewing",
        "discussion", "discussing", "pending", "idea", "exploratory", "candidate", "open", "new", "unreviewed", "rfc",
        "experimental", "alpha", "beta", "incubating",
    )),
)

RETIRING_DIRECTORIES = (
    "archive", "archived", "attic", "deprecated", "graveyard", "historical", "obsolete", "rejected", "retired", "superseded", "superceded", "withdrawn",
)
STATUS_KEYS = ("status", "state", "stage", "lifecycle", "phase", "adr-status")
STATUS_HEADINGS = ("status", "state", "stage", "lifecycle", "current status")
ID_KEYS = ("id", "adr", "adr-id", "rfc", "rfc-id", "kep-number", "number", "slug")

RECEPTIVITY = {"draft": "receptive", "active": "receptive", "frozen": "sealed", "retired": "sealed", "record": "sealed", "unknown": "unknown"}
OPENNESS = {"unresolved": "open", "narrowed": "partial", "delegated": "open", "satisfied": "closed", "accepted-debt": "closed", "rejected": "closed", "obviated": "closed"}

#: kind: (load-bearing, transfers an obligation, about a lifecycle, phrase)
EDGE_TRAITS = {
    "contains": (False, False, False, "contains"),
    "references": (False, False, False, "references"),
    "relates-to": (False, False, False, "relates to"),
    "depends-on": (True, False, False, "depends on"),
    "assumes": (True, False, False, "assumes"),
    "delegates-to": (False, True, False, "delegates to"),
    "blocked-by": (True, True, False, "is blocked by"),
    "supersedes": (False, False, True, "supersedes"),
    "amends": (True, False, True, "amends"),
}
EDGE_KINDS = tuple(EDGE_TRAITS)
OBLIGATION_EDGES = ("delegates-to", "blocked-by")

SEVERITIES = {
    "ghost-handover": "error",
    "stale-premise": "error",
    "broken-reference": "error",
    "reference-outside-corpus": "warn",
    "ambiguous-reference": "warn",
    "circular-delegation": "error",
    "orphaned-obligation": "error",
    "live-supersession": "error",
    "unreciprocated-supersession": "warn",
    "state-conflict": "warn",
    "self-reference": "info",
    "unknown-relation-key": "warn",
}
SEVERITY_ORDER = {"error": 0, "warn": 1, "info": 2}
REFERENCE_RULES = ("broken-reference", "reference-outside-corpus", "ambiguous-reference", "unknown-relation-key")
CLOSED_ROUND_RULES = ("ghost-handover", "stale-premise")

SELECTOR_KEYS = (
    "alias", "body", "conflicted", "disposition", "document", "evidence", "file", "id", "kind", "line",
    "openness", "path", "phase", "receptivity", "section", "state", "status", "text", "title",
)
NODE_WORDS = {
    "document": "document", "documents": "document", "doc": "document", "docs": "document",
    "item": "item", "items": "item", "node": None, "nodes": None, "any": None, "*": None,
}

FAMILY_DIRECTORIES = {
    "adr": "ADR", "adrs": "ADR", "architecture-decisions": "ADR", "decision-records": "ADR", "decisions": "ADR",
    "rfc": "RFC", "rfcs": "RFC", "kep": "KEP", "keps": "KEP", "enhancements": "KEP",
    "proposal": "PROPOSAL", "proposals": "PROPOSAL", "design": "DESIGN", "designs": "DESIGN",
    "prd": "PRD", "prds": "PRD", "spec": "SPEC", "specs": "SPEC",
}
DOCUMENT_EXTENSIONS = ("md", "markdown", "mdx", "txt", "rst", "adoc", "asciidoc")
