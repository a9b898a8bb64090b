"""The packet protocol that carries blocks: builders of what a client sends, and replay of what a server sends."""
