"""The event vocabulary, states, labels, limits and wording of the data model."""

# event types
ALERT_RECEIVED = "alert.received"
INCIDENT_OPENED = "incident.opened"
EXTRACTION_COMPLETED = "extraction.completed"
CHAINS_DETECTED = "causal.chains_detected"
RUNBOOK_RETRIEVED = "runbook.retrieved"
OWNERSHIP_SUGGESTED = "ownership.suggested"
SKIPPED = "SKIPPED_NOT_CONFIGURED"
RELATED_ITEMS = "context.related_items"
STEP_SELECTED = "runbook.step_selected"
STATE_TRANSITION = "state.transition"
OWNER_CONFIRMED = "owner_confirmed"
DEGRADED = "DEGRADED"
AGENT_ERROR = "agent.error"
REPORT_ERROR = "postmortem_error"
REPORT_TOKEN = "postmortem_token"
REPORT_COMPLETE = "postmortem_complete"
BLOCKED = "BLOCKED_BY_GUARDRAIL"
ACTION_EXECUTED = "action.executed"

# incident states and legal moves
INVESTIGATING = "INVESTIGATING"
MITIGATING = "MITIGATING"
RESOLVED = "RESOLVED"
STATES = (INVESTIGATING, MITIGATING, RESOLVED)
LEGAL_MOVES = ((INVESTIGATING, MITIGATING), (MITIGATING, RESOLVED))

# step names inside payloads
CONTEXT_STEP = "airbyte_context_lookup"
REPORT_STEP = "postmortem"
REPORT_SKIP_STEP = "postmortem_generation"

# timeline tone labels
TONE_LABELS = {
    "skipped": "SKIPPED — NOT CONFIGURED",
    "degraded": "DEGRADED",
    "blocked": "BLOCKED BY GUARDRAIL",
    "error": "ERROR",
}

# opening words of timeline summaries; readers of other logs may pass their own
SUMMARY_WORDS = {
    EXTRACTION_COMPLETED: "extraction — severity ",
    CHAINS_DETECTED: "causal query complete",
    RUNBOOK_RETRIEVED: "runbook (cited): ",
}

# onset detection defaults
BASELINE_ROWS = 60
MIN_BASELINE_ROWS = 12
THRESHOLD_Z = 3.0
WINDOW_MINUTES = 15

# extraction and screening labels
SEVERITIES = ("P0", "P1", "P2", "P3")
SERVICE_ENTITY = "affected_service"
SAFETY_TASK = "prompt_safety"
SAFETY_LABELS = ("safe", "unsafe")

# outbound actions and wording
CHAT_ACTION = "SLACK_SEND_MESSAGE"
TICKET_ACTION = "JIRA_CREATE_ISSUE"
CHAT_CHANNEL = "#incidents"
PROJECT_KEY = "INC"
SUGGESTION = "Suggested owner — awaiting confirmation"
HUMAN_CONFIRMS = "A human must confirm"
NO_MATCH_ANSWER = "No results found for your query."
CITATION_PREFIX = "senso:"

# retrieval intents: query prefix per kind of document
INTENTS = {
    "runbook": "runbook: ",
    "ownership": "service ownership map: ",
    "precedent": "past incident postmortem: ",
}
MAX_RESULTS = 3

# report layout
SECTIONS = ("Timeline", "Root Cause", "Impact", "Action Items")
LOG_BEGIN = "=== BEGIN TYPED EVENT LOG (verbatim) ==="
LOG_END = "=== END TYPED EVENT LOG ==="
MAX_TOKEN_DELAY = 0.10

# call telemetry
TRANSIENT_STATUS = (408, 425, 429, 500, 502, 503, 504)
RETRY_ATTEMPTS = 3
BACKOFF_BASE = 0.5
BREAKER_FAILURES = 5
BREAKER_COOLDOWN = 30.0
