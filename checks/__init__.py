"""What the driver's tables stand for, the registered queries, and their SQL twins."""
