"""The localization filter, tracker and gates, for replays and for streams."""
