"""Where tables come from and go to: schemas, calendars, message records, sinks."""
