"""Part of the event-history engine."""
