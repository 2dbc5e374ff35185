"""Table schemas, versioned tables, snippet content and message queues."""
