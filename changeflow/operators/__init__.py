"""DataFrame operators; each takes whole tables or a micro-batch."""
