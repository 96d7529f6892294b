"""Named query plans over the driver's tables, with their SQL counterparts."""
