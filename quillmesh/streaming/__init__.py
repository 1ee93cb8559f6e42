"""The stateless steps on streams of comments."""
