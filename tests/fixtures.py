"""C# sources of our own for parser and build tests."""

SHAPES = '''using System;
using System.Collections.Generic;

namespace Garden.Beds
{
    public abstract class Bed : Plot, IWatered
    {
        private const int Rows = 4, Columns = 6;
        public static readonly string Label = "garden/bed_one";
        public int Moisture { get; private set; }
        public bool IsDry => Moisture < 3;

        public Bed() { Moisture = Rows; }
        static Bed() { }

        public virtual void Water(int litres)
        {
            Moisture += litres;
            Log("water the bed");
        }

        public virtual void Water(string by, int litres)
        {
            Log("water the bed");
            Water(litres);
        }

        protected static void Log(string text) { Console.WriteLine(text); }

        public class Corner
        {
            public enum Side { Left, Right }
        }
    }

    public class Plot { public int size; public Plot Neighbour; public virtual int Area() { return size * size; } }
    public interface IWatered { void Water(int litres); }
    internal struct Seed { public string kind; }
    public delegate void Grown(Bed bed);
    public record Harvest(int Kilos);
}

class Loose { string where = @"C:\\tools\\spade"; }
'''

HERBS = '''using Garden.Beds;
using UnityEngine;

namespace Garden.Beds;

public class HerbBed : Bed
{
    private List<Plot> plots = new List<Plot>();
    private Plot home;
    public static int planted;

    public HerbBed(Plot plot) { home = plot; }

    public override void Water(int litres)
    {
        base.Water(litres);
        planted++;
        home.size = litres;
        home.Neighbour.size += 2;
        var area = home.Neighbour.Area();
        Plot other = (Plot)Find(area);
        Plot third = Find(3) as Plot;
        Debug.Log("herbs");
        Ping(1);
        unknownThing.Go();
        foreach (var p in plots) { p.Area(); }
    }

    public object Find(int n) { return new Plot(); }
    void Ping(int n) { Pong(n); }
    void Pong(int n) { Ping(n); }
    public HerbBed Clone() { return new HerbBed(home); }
}
'''

ADDON = '''using Garden.Beds;
namespace Addon
{
    public class Plot { public int own; }
    public class Greenhouse : Garden.Beds.Bed
    {
        public void Open(Garden.Beds.Plot outside)
        {
            outside.size = 3;
            outside.Neighbour.size = 4;
            Plot mine = new Plot();
            mine.own = 1;
            Water(2);
        }
        public override void Water(int litres) { }
    }
}
'''

BROKEN = "namespace Garden { public class Half { public void Open( { "
NOTHING = "%%% this is no source at all {{{"


def write(root, files: dict[str, str]):
    for name, text in files.items():
        (root / name).parent.mkdir(exist_ok=True, parents=True)
        (root / name).write_bytes(text.encode())
    return str(root)
