try:
    import fast
except ImportError:
    fast = None
if True:
    def hidden():
        pass
