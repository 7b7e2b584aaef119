"""Reading hand-written lists and logs, and writing reports."""
