from subscope.sources.binding import Tables, bind, bind_sessions  # noqa: F401
