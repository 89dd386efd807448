"""The eight-stage job and the event-derived trajectory view."""
