"""DataFrame operators: filters, sessions, texts, hours, usage, weeks, ledgers."""
