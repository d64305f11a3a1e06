"""Result assembly: report-level roll-ups, the summary record, sinks."""
