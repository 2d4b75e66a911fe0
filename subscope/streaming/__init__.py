from subscope.streaming.activity import (  # noqa: F401
    daily_active_users_stream, inactivity_alerts_stream, session_stream,
)
