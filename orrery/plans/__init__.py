"""From a question to a plan, and from a plan to rows."""
