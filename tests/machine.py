"""Row-at-a-time state machine over one prompt's attempts, to check the fold against."""


def replay(outcomes, max_attempts):
    """(status, attempts, index of the deciding attempt) after applying outcomes in order."""
    status, attempts, last = "pending", 0, None
    for i, outcome in enumerate(outcomes):
        if status in ("succeeded", "failed"):
            break
        attempts += 1
        last = i
        if outcome == "success":
            status = "succeeded"
        elif outcome == "permanent":
            status = "failed"
        elif outcome == "rate_limited":
            attempts -= 1
        elif outcome == "transient" and attempts >= max_attempts:
            status = "failed"
    return status, attempts, last


RAW = {
    "success": (200, '{"completion":"done"}', None),
    "permanent": (400, "bad", None),
    "rate_limited": (429, "wait", None),
    "transient": (503, "busy", None),
    "abandoned": (None, None, None),
}
SCHEMA = (
    "prompt_id string, batch_id string, round bigint, finished_at timestamp_ntz, http_status int, retry_after string, "
    "body string, transport_error string"
)


def log_rows(logs, start):
    from datetime import timedelta

    for prompt, outcomes in logs.items():
        for i, outcome in enumerate(outcomes):
            status, body, failure = RAW[outcome]
            yield (prompt, prompt.split("-")[0], i, start + timedelta(minutes=i), status, None, body, failure)
